"""Metadata records: identity, names, defaults, manifests, rendered artifacts, sections and versions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WS, let, or_empty, strip_ws

#: Order of a profile's fields in an identity line.
IDENTITY_FIELDS = ("company", "level", "role", "occupation", "identity", "specialty", "known_for")
#: What a family's records get by default.
PRESETS = (
    # family, label, domain, relationship, real, public, fictional, storage root, legacy root
    ("colleague", "Colleague", "work", "coworker", True, False, False, "skills/colleague", "colleagues"),
    ("relationship", "Relationship", "personal", "relationship", True, False, False, "skills/relationship", "skills/relationship"),
    ("celebrity", "Celebrity", "public", "public_figure", True, True, False, "skills/celebrity", "skills/celebrity"),
)
SCHEMA_VERSION = "3"
RETAINED = 10


def identity(profile: dict[str, Column], label: Column, mbti: Column) -> Column:
    """The profile's fields in order, or the family's label; then the MBTI type."""
    fields = F.array(*[profile.get(f, F.lit(None).cast("string")) for f in IDENTITY_FIELDS])
    joined = F.array_join(F.filter(fields, lambda x: or_empty(x) != ""), " ")
    return F.concat(F.when(joined == "", label).otherwise(joined), F.when(or_empty(mbti) != "", F.concat(F.lit(", MBTI "), mbti)).otherwise(""))


def artifact_names(kind: Column, slug: Column) -> dict[str, Column]:
    base = F.concat(kind, F.lit("_"), slug)
    command = F.concat(kind, F.lit("-"), F.replace(slug, F.lit("_"), F.lit("-")))
    out = {"combined_name": base, "work_name": F.concat(base, F.lit("_work")), "persona_name": F.concat(base, F.lit("_persona"))}
    return out | {"combined_command": command, "work_command": F.concat(command, F.lit("-work")), "persona_command": F.concat(command, F.lit("-persona"))}


def front(name: Column, description: Column, body: Column) -> Column:
    return F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: "), description, F.lit("\nuser-invocable: true\n---\n\n"), body, F.lit("\n"))


def language_code(own: Column, classified: Column | None = None) -> Column:
    """The record's language, else its classification's, else en; lower-cased."""
    given = [x for x in (own, classified) if x is not None]
    return F.lower(F.coalesce(*[F.nullif(x, F.lit("")) for x in given], F.lit("en")))


#: The combined artifact, in English and in Chinese.
COMBINED_EN = """---
name: {combined_name}
description: {description}
user-invocable: true
---

# {display_name}

{identity}

---

## PART A: Work

{work_content}

---

## PART B: Persona

{persona_content}

---

## Operating Rules

When any task or question arrives:

1. **Start with PART B**: decide whether you would take the task and in what attitude.
2. **Execute with PART A**: use the work methods, heuristics, and capability profile to do the task.
3. **Keep PART B in the output**: preserve the tone, diction, rhythm, and reaction patterns from the persona.

**Layer 0 rules in PART B always take priority and must never be violated.**
"""
COMBINED_ZH = """---
name: {combined_name}
description: {description}
user-invocable: true
---

# {display_name}

{identity}

---

## PART A：工作能力

{work_content}

---

## PART B：人物性格

{persona_content}

---

## 运行规则

接收到任何任务或问题时：

1. **先由 PART B 判断**：你会不会接这个任务？用什么态度接？
2. **再由 PART A 执行**：用你的技术能力和工作方法完成任务
3. **输出时保持 PART B 的表达风格**：你说话的方式、用词习惯、句式

**PART B 的 Layer 0 规则永远优先，任何情况下不得违背。**
"""


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its column; the values themselves are not looked into."""
    parts = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(values[piece] if k % 2 else F.lit(piece))
    return F.concat(*parts)


def render_parts(names: dict[str, Column], display: Column, language: Column, work: Column, persona: Column) -> dict[str, Column]:
    """The work and persona artifacts; languages that begin with zh get Chinese descriptions."""
    zh = or_empty(language).startswith("zh")
    says = lambda cn, en: F.concat(display, F.when(zh, cn).otherwise(en))
    return {
        "work_skill": front(names["work_name"], says(" 的工作能力（仅 Work，无 Persona）", " work capability only (without persona)"), work),
        "persona_skill": front(names["persona_name"], says(" 的人物性格（仅 Persona，无工作能力）", " persona only (without work capability)"), persona),
    }


def render_combined(names: dict[str, Column], display: Column, who: Column, summary: Column, language: Column, work: Column, persona: Column) -> Column:
    """The combined artifact. Its description is the summary, else the display name and the identity, if any."""
    about = F.when(or_empty(who) == "", display).otherwise(F.concat(display, F.lit(", "), who))
    values = {"combined_name": names["combined_name"], "description": F.coalesce(F.nullif(summary, F.lit("")), about), "display_name": display, "identity": or_empty(who), "work_content": work, "persona_content": persona}
    return F.when(or_empty(language).startswith("zh"), filled(COMBINED_ZH, values)).otherwise(filled(COMBINED_EN, values))


def artifacts(rows: DataFrame, files: dict[str, Column], names: dict[str, Column], display: Column, who: Column, summary: Column, language: Column, work: Column, persona: Column, manifest: Column, meta: Column, keep: list[str]) -> DataFrame:
    """keep, file and content: one row for each of the seven artifacts of each record.

    files: the records' own file names by what they hold, as in FILES of the metadata; manifest and meta as JSON.
    """
    parts = render_parts(names, display, language, work, persona)
    combined = render_combined(names, display, who, summary, language, work, persona)
    contents = (("work_doc", work), ("persona_doc", persona), ("combined_skill", combined), ("work_skill", parts["work_skill"]), ("persona_skill", parts["persona_skill"]), ("manifest", manifest))
    each = F.array(*[F.struct(files[f].alias("file"), c.alias("content")) for f, c in contents], F.struct(F.lit("meta.json").alias("file"), meta.alias("content")))
    return rows.select(*keep, F.explode(each).alias("a")).select(*keep, "a.file", "a.content")


def install_record(host: Column, command: Column, meta: dict[str, Column], source: Column, artifact: Column, installed_at: Column) -> Column:
    """What is noted of an installed record, as JSON; its markdown is renamed by rename_frontmatter()."""
    return F.to_json(F.struct(
        host.alias("host"), command.alias("command_name"), meta["character"].alias("character"), meta["slug"].alias("slug"), meta["version"].alias("version"),
        source.alias("source_skill_dir"), artifact.alias("source_artifact"), installed_at.alias("installed_at"),
    ))


def merged(defaults: Column, given: Column) -> Column:
    """Both maps together; where both have a key, what is given wins, null included. A null map counts as empty."""
    given = F.coalesce(given, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given)


def parsed_records(stored: DataFrame, folder: str, schema: str) -> DataFrame:
    """schema's columns and ``folder`` of JSON texts in ``value``; those that aren't a whole JSON object are left out."""
    rows = stored.select(F.col(folder).alias("folder"), F.from_json("value", schema).alias("m"), F.schema_of_variant(F.try_parse_json("value")).alias("__kind"))
    return rows.where(F.col("__kind").startswith("OBJECT")).select("folder", "m.*")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """parsed_records() of meta.json in each folder below path, in order of the folders' names."""
    raw = spark.read.text(f"{path}/*/meta.json", wholetext=True)
    named = raw.withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/meta\.json$", 1))
    return parsed_records(named, "folder", schema).orderBy("folder")


def corrections_count(before: Column, items: Column) -> Column:
    """The record's counter after these corrections, those that have left the log included."""
    return (F.coalesce(before, F.lit(0)) + F.size(items)).cast("long")


# Sections -------------------------------------------------------------------------------------------


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, heading, body): level-2 sections in order; what stands before the first has heading ''."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=##\s)")
    rows = docs.select(key, F.posexplode(parts).alias("pos", "part"))
    heading = strip_ws(F.regexp_extract("part", r"^(##\s+[^\n]+)", 1))
    return rows.select(key, "pos", heading.alias("heading"), strip_ws(F.regexp_replace("part", r"^##\s+[^\n]+", "")).alias("body"))


def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """(key, heading, place, body, status): sections after one patch, and what became of each.

    Of equal headings in the document the first is replaced, of those in the patch the last counts; new ones come
    after, in the patch's order. What a patch says before its first heading is left out, but a patch without
    headings is appended as a whole. For texts as they are after many patches see merge_patches().
    """
    headed = patch.where("heading <> ''").groupBy(key, "heading").agg(F.min("pos").alias("__pos"), F.max_by("body", "pos").alias("__body"))
    whole = patch.where("heading = '' AND body <> ''").join(headed.select(key).distinct(), key, "left_anti").select(key, "heading", F.lit(2_000_000).alias("place"), "body", F.lit("appended").alias("status"))
    nth = F.row_number().over(Window.partitionBy(key, "heading").orderBy("pos"))
    both = old.withColumn("__nth", nth).join(headed.withColumn("__nth", F.lit(1)), [key, "heading", "__nth"], "full_outer")
    place = F.coalesce(F.col("pos"), F.lit(1_000_000) + F.col("__pos"))
    status = F.when(F.col("__body").isNull(), "kept").when(F.col("body").isNull(), "appended").when(F.col("__body") == F.col("body"), "confirmed").otherwise("replaced")
    return both.select(key, "heading", place.alias("place"), F.coalesce("__body", "body").alias("body"), status.alias("status")).unionByName(whole)


_SPACE = "[" + re.escape(WS) + "]"
#: Where a level-2 section begins; a line's end is a line feed alone.
_SECTION = rf"(?md)(?=^##{_SPACE}+[^\n])"


def merge_patch(text: Column, patch: Column) -> Column:
    """text after one patch: each of its level-2 sections takes the place of the first one with its heading, or comes last.

    Text before the patch's first heading is left out; a patch without headings is appended. An empty one changes nothing.
    """
    part = lambda xs, i: or_empty(F.get(xs, F.lit(i)))

    def placed(state: Column, section: Column) -> Column:
        quoted = F.replace(F.regexp_substr(section, F.lit(rf"^##{_SPACE}+[^\n]+")), F.lit("\\E"), F.lit(r"\E\\E\Q"))
        line = F.concat(F.lit(r"(?md)^\Q"), quoted, F.lit(rf"\E{_SPACE}*$"))
        around = lambda xs: F.concat(F.rtrim(part(xs, 0), F.lit(WS)), F.lit("\n\n"), strip_ws(section), F.lit("\n\n"), F.ltrim(part(F.split(part(xs, 1), F.lit(_SECTION), 2), 1), F.lit(WS)))
        last = F.concat(F.rtrim(state["text"], F.lit(WS)), F.lit("\n\n"), strip_ws(section))
        return let(F.split(state["text"], line, 2), lambda xs: F.when(F.size(xs) > 1, F.struct(around(xs).alias("text"), F.lit(True).alias("replaced"))).otherwise(F.struct(last.alias("text"), state["replaced"].alias("replaced"))))

    def folded(sections_: Column) -> Column:
        done = F.aggregate(sections_, F.struct(text.alias("text"), F.lit(False).alias("replaced")), placed)
        return let(done, lambda d: F.when(d["replaced"], F.concat(strip_ws(d["text"]), F.lit("\n"))).otherwise(d["text"]))

    appended = F.concat(text, F.when(text == "", "").otherwise("\n\n"), patch)
    headed = F.filter(F.split(patch, _SECTION), lambda x: x.rlike(rf"^##{_SPACE}+[^\n]"))
    return F.when(or_empty(patch) == "", text).otherwise(let(headed, lambda xs: F.when(F.size(xs) == 0, appended).otherwise(folded(xs))))


def merge_patches(text: Column, patches: Column) -> Column:
    """text after an array of patches, in their order; a null text counts as empty."""
    return F.aggregate(patches, or_empty(text), merge_patch)


def joined_sections(rows: DataFrame, key: str) -> DataFrame:
    entry = F.transform(F.array_sort(F.collect_list(F.struct("place", "heading", "body"))), lambda s: F.concat_ws("\n\n", F.nullif(s["heading"], F.lit("")), F.nullif(s["body"], F.lit(""))))
    return rows.groupBy(key).agg(F.array_join(F.filter(entry, lambda x: x != ""), "\n\n").alias("text"))


#: Headings of a correction log, and what an empty one says.
LOGS = (("## Correction Log", "(No entries yet)"), ("## Correction 记录", "（暂无记录）"))


def apply_corrections(persona: Column, corrections: Column, logs=LOGS) -> Column:
    """persona with each correction right after a log's heading, newest first.

    Of the headings the first that the text holds is used, wherever it stands; without any the first is added.
    """
    line = lambda c: F.concat(F.lit("\n- ["), c["scene"], F.lit("] should not "), c["wrong"], F.lit("; should "), c["correct"])

    def put(text, c):
        out = F.concat(text, F.lit(f"\n\n{logs[0][0]}\n"), line(c), F.lit("\n"))
        for heading, empty in reversed(logs):
            at = F.locate(heading, text)
            rest = F.substring(text, at + len(heading), F.length(text))
            rest = F.when(rest.startswith("\n\n" + empty), F.substring(rest, F.lit(len(empty) + 3), F.length(rest))).otherwise(rest)
            out = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1 + len(heading)), line(c), rest)).otherwise(out)
        return out

    return F.aggregate(corrections, persona, put)


def newest_corrections(persona: Column, most: int = 50, heading: str = "## Correction Log") -> Column:
    """persona with only the first ``most`` entries right after the log's heading, which are the newest."""
    lines = F.split(persona, "\n")

    def cut_log(xs):
        at = F.array_position(xs, heading)
        entry = lambda x, i: (i >= at) & x.startswith("- [")
        nth = F.aggregate(xs, F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("gone")), lambda s, x: F.struct(
            (s["n"] + entry(x, s["i"]).cast("int")).alias("n"), (s["i"] + 1).alias("i"),
            F.when(entry(x, s["i"]) & (s["n"] >= most), F.concat(s["gone"], F.array(s["i"]))).otherwise(s["gone"]).alias("gone")))
        return F.when(at > 0, F.array_join(let(nth["gone"], lambda gone: F.filter(xs, lambda x, i: ~F.array_contains(gone, i))), "\n")).otherwise(persona)

    return let(lines, cut_log)


# Versions -------------------------------------------------------------------------------------------


def next_version(version: Column) -> Column:
    """v<n + 1> of v<n> or v<n>_<label>; v2 where there is no number."""
    n = F.regexp_extract(version, r"^v*(-?\d+)(_.*)?$", 1)
    return F.concat(F.lit("v"), (F.coalesce(n.try_cast("int"), F.lit(1)) + 1).cast("string"))


def chain(events: DataFrame, key: str, *order: str) -> DataFrame:
    """events with the version each makes and the one it archives."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumns({"version": F.concat(F.lit("v"), n.cast("string")), "archived": F.when(n > 1, F.concat(F.lit("v"), (n - 1).cast("string")))})


def retained(versions: DataFrame, key: str, *newest_first: Column, most: int = RETAINED) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))
    return versions.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def rolled_back(versions: DataFrame, key: str, target: str) -> DataFrame:
    """(key, seq, version, body) with two rows more for each key that has the target version: a backup of the
    current state, and the target's body as the new current state. Nothing is overwritten."""
    last = F.max_by(F.struct("version", "body"), "seq")
    now = versions.groupBy(key).agg(F.max("seq").alias("seq"), last.alias("current"), F.max_by(F.when(F.col("version") == target, F.col("body")), F.when(F.col("version") == target, F.col("seq"))).alias("old"))
    now = now.where(F.col("old").isNotNull())
    backup = now.select(key, (F.col("seq") + 1).alias("seq"), F.concat("current.version", F.lit("_before_rollback")).alias("version"), F.col("current.body").alias("body"))
    restored = now.select(key, (F.col("seq") + 2).alias("seq"), F.lit(f"{target}_restored").alias("version"), F.col("old").alias("body"))
    return versions.select(key, "seq", "version", "body").unionByName(backup).unionByName(restored)
