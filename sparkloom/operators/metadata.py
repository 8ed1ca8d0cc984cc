"""Record metadata as nested JSON: defaults that tell absent from null and empty, and the manifest.

A record is a VARIANT object whose keys aren't known beforehand. Objects are taken apart into maps of variants and
merged key by key: ``under()`` fills keys that are absent and keeps null and empty values, ``first()`` passes over
null and empty ones and looks in several places. What a family of records gets by default is a table of presets,
one row a family and research profile, which is joined; its JSON columns may hold whatever a user's presets hold.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, or_empty, strip_ws
from .classify import family
from .nested import plain, truthy
from .records import IDENTITY_FIELDS, PRESETS, SCHEMA_VERSION, artifact_names

MAP = "map<string,variant>"
#: Folders of a record's sources, and what public figures have besides.
FOLDERS = ("docs", "messages", "emails")
RESEARCH_FOLDERS = ("research/raw", "research/merged", "research/reviews", "transcripts", "subtitles")
#: Family, research profile, whether it is the family's default, merge strategy, quality profile, older command.
PROFILES = (
    ("colleague", "standard", True, "compact", "budget-friendly", "/create-colleague"),
    ("relationship", "standard", True, "compact", "budget-friendly", "/create-ex"),
    ("celebrity", "budget-friendly", True, "compact", "budget-friendly", "/create-icon"),
    ("celebrity", "budget-unfriendly", False, "deep", "budget-unfriendly", "/create-icon"),
)
#: File names by what they hold.
FILES = {"combined_skill": "SKILL.md", "work_skill": "work_skill.md", "persona_skill": "persona_skill.md", "work_doc": "work.md", "persona_doc": "persona.md", "manifest": "manifest.json"}
PRESET_SCHEMA = (
    "family string, profile string, is_default boolean, label string, preset string, legacy_command string, legacy_root string, "
    "source_context string, shared string, tools string"
)


class Bundles(NamedTuple):
    """What a user's presets add: an engine's name, prompt files by family, files and references by (family, profile),
    research tools by family, and where records can be installed."""

    engine: str = "meta-skill"
    version: str = "v1"
    prompts: dict[str, dict] = {}
    profile_prompts: dict[tuple[str, str], dict] = {}
    references: dict[tuple[str, str], list[str]] = {}
    tools: dict[str, dict] = {}
    runtimes: tuple[str, ...] = ()
    installers: dict[str, str] = {}


def preset_table(spark: SparkSession, bundles: Bundles = Bundles()) -> DataFrame:
    """One row a family and research profile; ``shared`` is what engine and generation both get, as maps of variants."""
    known, rows = {p[0]: p for p in PRESETS}, []
    for name, profile, is_default, strategy, quality, command in PROFILES:
        _, label, domain, relationship, real, public, fictional, root, legacy = known[name]
        preset = f"{name}.{bundles.version}"
        context = {"domain": domain, "relationship_to_user": relationship, "is_real_person": real, "is_public_figure": public, "is_fictional": fictional}
        shared = {
            "prompt_bundle": {"preset": preset} | bundles.prompts.get(name, {}), "research_profile_bundle": bundles.profile_prompts.get((name, profile), {}),
            "research_profile_references": bundles.references.get((name, profile), []), "merge_strategy": strategy, "quality_profile": quality,
            "knowledge_dirs": [*FOLDERS, *(RESEARCH_FOLDERS if public else ())], "storage_root": root,
        }
        tools = {"research_tools": bundles.tools[name]} if bundles.tools.get(name) else {}
        rows.append((name, profile, is_default, label, preset, command, legacy, json.dumps(context), json.dumps(shared), json.dumps(tools)))
    return spark.createDataFrame(rows, PRESET_SCHEMA).withColumns({c: members(F.parse_json(c)) for c in ("source_context", "shared", "tools")})


# Variants -------------------------------------------------------------------------------------------


def members(value: Column) -> Column:
    """An object's members; none of anything else."""
    return F.coalesce(F.try_variant_get(value, "$", MAP), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def inside(value: Column, name: str) -> Column:
    """The members of the object under a name."""
    return members(F.try_variant_get(value, f"$.{name}", "variant"))


def said(text: Column | str) -> Column:
    """A text, number or boolean as a variant; null as JSON's null."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("variant"), F.parse_json(F.lit("null")))


def put(over: Column, **values: Column) -> Column:
    """The map with these members, which take the place of those it has."""
    return F.map_concat(F.map_filter(over, lambda k, v: ~k.isin(*values)), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))


def under(given: Column, defaults: Column) -> Column:
    """The given members, and the defaults whose keys are absent; a null or empty value that is given stays."""
    return let(given, lambda g: F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(g, k)), g))


def object_of(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def first(*values: Column) -> Column:
    """The first truthy variant."""
    return F.coalesce(*[truthy(v) for v in values])


def strings(value: Column) -> Column:
    """The texts of a list that aren't empty; none if it isn't a list."""
    texts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: (F.schema_of_variant(x) == "STRING") & (plain(x) != ""))
    return F.coalesce(F.transform(texts, plain), F.array().cast("array<string>"))


def as_variant(members_: Column) -> Column:
    return F.to_variant_object(members_)


def identity_of(meta: Column, label: Column) -> Column:
    """A profile's text, or its fields in order and its MBTI type; the label where there is neither."""
    profile = F.try_variant_get(meta, "$.profile", "variant")
    field = lambda k: plain(truthy(F.try_variant_get(profile, f"$.{k}", "variant")))
    joined = F.array_join(F.filter(F.array(*map(field, IDENTITY_FIELDS)), lambda x: x != ""), " ")
    named = F.concat(F.when(joined == "", label).otherwise(joined), F.when(field("mbti") != "", F.concat(F.lit(", MBTI "), field("mbti"))).otherwise(""))
    kind = F.schema_of_variant(profile)
    return F.when(kind == "STRING", F.coalesce(F.nullif(strip_ws(plain(profile)), F.lit("")), label)).when(kind.startswith("OBJECT"), named).otherwise(label)


def older_tags(meta: Column) -> Column:
    """The tags of records written before tags were classified: a list, or lists under two names."""
    tags = F.try_variant_get(meta, "$.tags", "variant")
    return F.when(F.schema_of_variant(tags).startswith("ARRAY"), strings(tags)).otherwise(
        F.concat(strings(F.try_variant_get(tags, "$.personality", "variant")), strings(F.try_variant_get(tags, "$.culture", "variant"))))


# Records --------------------------------------------------------------------------------------------


def with_presets(rows: DataFrame, presets: DataFrame, meta: str = "meta") -> DataFrame:
    """rows with ``family``, ``research_profile`` and ``preset``, the preset's row as a struct.

    The family is looked up as character, type and generation's character; the profile at the top, in generation and
    in engine, spelled freely. A family without such a profile gives its default one. There are three families, so the
    table is small and sent to all tasks: rows dealt by family would be the work of three of them.
    """
    m = F.col(meta)
    at = lambda path: F.try_variant_get(m, f"$.{path}", "variant")
    asked = F.regexp_replace(F.lower(strip_ws(or_empty(plain(first(*map(at, ("research_profile", "generation.research_profile", "engine.research_profile")))))), ), "_", "-")
    named = rows.withColumns({"family": family(plain(first(*map(at, ("character", "type", "generation.character"))))), "__asked": asked})
    table = presets.select(F.struct(*presets.columns).alias("__p"))
    own = table.select(F.col("__p.family").alias("family"), F.col("__p.profile").alias("__asked"), F.col("__p").alias("__own"))
    usual = table.where("__p.is_default").select(F.col("__p.family").alias("family"), F.col("__p").alias("__usual"))
    out = named.join(F.broadcast(own), ["family", "__asked"], "left").join(F.broadcast(usual), "family", "left").withColumn("preset", F.coalesce("__own", "__usual"))
    return out.withColumn("research_profile", F.col("preset.profile")).drop("__own", "__usual", "__asked")


def enriched(rows: DataFrame, presets: DataFrame, now: Column, engine: str = Bundles().engine, slug: str = "slug", meta: str = "meta") -> DataFrame:
    """rows whose ``meta``, a variant, has all defaults of its family and profile; keys of its own stay.

    ``or`` rules (kind, preset, names, id, dates, version, type, summary) pass over null and empty values and look at
    the top, then in lifecycle or generation; set-default rules (subtype, all members of source_context,
    classification, engine, generation, artifacts, compat, lifecycle's status) keep them. A section that isn't an
    object counts as empty, and a record that isn't one has no keys; a null slug stays null. Rows that repeat a slug
    are filled in each on its own. No rows in, none out.
    """
    known = with_presets(rows, presets, meta)
    m, s, p = F.col(meta), F.col(slug), F.col("preset")
    at = lambda path: F.try_variant_get(m, f"$.{path}", "variant")
    text = lambda *paths, default: F.coalesce(*[F.nullif(plain(truthy(at(x))), F.lit("")) for x in paths], default)
    own, generation, lifecycle = members(m), inside(m, "generation"), inside(m, "lifecycle")
    known = known.withColumns({
        "__name": text("display_name", "name", default=s), "__kind": text("kind", default=F.lit("meta-skill")), "__preset": text("preset", "generation.preset", default=p["preset"]),
        "__created": text("created_at", "lifecycle.created_at", default=now), "__version": text("version", "lifecycle.version", default=F.lit("v1")),
        "__identity": identity_of(m, p["label"]),
        "__corrections": F.when(F.map_contains_key(own, "corrections_count"), F.element_at(own, "corrections_count")).when(F.map_contains_key(generation, "corrections_count"), F.element_at(generation, "corrections_count")).otherwise(said(F.lit(0))),
    }).withColumns({"__updated": text("updated_at", "lifecycle.updated_at", default=F.col("__created")), "__named": text("name", default=F.col("__name"))})
    c = F.col
    shared = F.map_concat(p["shared"], p["tools"], object_of(character=said(c("family")), research_profile=said(c("research_profile")), preset=said(c("__preset"))))
    names = artifact_names(c("family"), s)
    files = object_of(**{k: said(v) for k, v in FILES.items()}, **{k: said(v) for k, v in names.items()})
    sources = F.when(F.map_contains_key(own, "knowledge_sources"), F.element_at(own, "knowledge_sources")).otherwise(F.parse_json(F.lit("[]")))
    sections = {
        "source_context": under(inside(m, "source_context"), p["source_context"]),
        "classification": under(inside(m, "classification"), object_of(gallery_category=said(p["label"]), tags=older_tags(m).cast("variant"), language=said("en"))),
        "artifacts": under(inside(m, "artifacts"), files),
        "engine": under(inside(m, "engine"), F.map_concat(shared, object_of(name=said(engine), kind=said("meta-skill")))),
        "generation": put(under(generation, F.map_concat(shared, object_of(engine=said(engine), created_from=sources))), corrections_count=c("__corrections")),
        "lifecycle": put(under(lifecycle, object_of(status=said("active"))), created_at=said(c("__created")), updated_at=said(c("__updated")), version=said(c("__version"))),
        "compat": under(inside(m, "compat"), object_of(legacy_command=said(p["legacy_command"]), legacy_storage_root=said(p["legacy_root"]), legacy_type=said(p["family"]))),
    }
    top = {
        "schema_version": said(SCHEMA_VERSION), "slug": said(s), "kind": said(c("__kind")), "character": said(c("family")), "research_profile": said(c("research_profile")), "preset": said(c("__preset")),
        "display_name": said(c("__name")), "name": said(c("__named")), "id": said(text("id", default=F.concat_ws(".", "__kind", "family", s))),
        "created_at": said(c("__created")), "updated_at": said(c("__updated")), "version": said(c("__version")), "corrections_count": c("__corrections"),
        "type": said(text("type", default=p["family"])), "summary": said(text("summary", default=F.concat("__name", F.lit(", "), "__identity"))),
    }
    whole = put(under(own, object_of(subtype=F.parse_json(F.lit("null")))), **top, **{k: as_variant(v) for k, v in sections.items()})
    return known.withColumn(meta, as_variant(whole)).select(*rows.columns)


def manifest_of(meta: Column, bundles: Bundles = Bundles()) -> Column:
    """An enriched record's manifest, a variant: what it is, its files and commands, and the engine's whole entry."""
    at = lambda path: F.coalesce(F.try_variant_get(meta, f"$.{path}", "variant"), F.parse_json(F.lit("null")))
    get = lambda k, default: F.coalesce(F.try_variant_get(meta, f"$.engine.{k}", "variant"), F.parse_json(F.lit(default)))
    plan = {"prompt_bundle": "{}", "research_profile": '"standard"', "research_profile_bundle": "{}", "research_profile_references": "[]", "merge_strategy": '"compact"', "quality_profile": '"budget-friendly"', "research_tools": "{}", "knowledge_dirs": "[]"}
    listed = F.array(at("artifacts.combined_skill"), at("artifacts.work_doc"), at("artifacts.persona_doc"), said("meta.json"), at("artifacts.manifest"))
    install = object_of(
        compatible_runtimes=F.parse_json(F.lit(json.dumps(list(bundles.runtimes)))), min_schema_version=said(SCHEMA_VERSION), installers=F.parse_json(F.lit(json.dumps(bundles.installers))),
        slash_commands=as_variant(object_of(default=at("artifacts.combined_command"), work=at("artifacts.work_command"), persona=at("artifacts.persona_command"))),
    )
    return as_variant(object_of(
        manifest_version=said("1"), **{k: at(k) for k in ("id", "kind", "character", "research_profile", "preset", "display_name", "engine")},
        entrypoints=as_variant(object_of(default=at("artifacts.combined_skill"), work=at("artifacts.work_skill"), persona=at("artifacts.persona_skill"))),
        artifacts=listed.cast("variant"), capabilities=F.parse_json(F.lit('["persona","work"]')),
        toolchain=as_variant(object_of(**{k: get(k, d) for k, d in plan.items()})), install=as_variant(install),
    ))


def fields_of(meta: Column) -> dict[str, Column]:
    """What other transforms need of an enriched record, as texts."""
    at = lambda path: plain(F.try_variant_get(meta, f"$.{path}", "variant"))
    top = ("slug", "kind", "character", "research_profile", "preset", "display_name", "name", "id", "created_at", "updated_at", "version", "type", "summary")
    return {k: at(k) for k in top} | {"label": at("classification.gallery_category"), "domain": at("source_context.domain"), "storage_root": at("engine.storage_root"), "language": F.lower(F.coalesce(*[F.nullif(x, F.lit("")) for x in (at("language"), at("classification.language"))], F.lit("en")))}


def files_of(meta: Column) -> dict[str, Column]:
    """The record's own names of its files, commands and artifacts, which may differ from the usual ones."""
    at = lambda k: plain(F.try_variant_get(meta, f"$.artifacts.{k}", "variant"))
    return {k: at(k) for k in (*FILES, "combined_name", "work_name", "persona_name", "combined_command", "work_command", "persona_command")}


def listed(rows: DataFrame, meta: str = "meta") -> DataFrame:
    """(slug, kind, character, research_profile, name, identity, version, updated_at, corrections_count) of enriched records."""
    f = fields_of(F.col(meta))
    return rows.select(
        *[f[k].alias(k) for k in ("slug", "kind", "character", "research_profile")], f["display_name"].alias("name"), identity_of(F.col(meta), f["label"]).alias("identity"),
        f["version"].alias("version"), f["updated_at"].alias("updated_at"), F.try_variant_get(meta, "$.corrections_count", "bigint").alias("corrections_count"),
    )
