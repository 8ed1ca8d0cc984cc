"""Records, versions, style and reports."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators import classify, metadata, nested, records, report, style
from ..sources.tables import spread, table
from .wave1 import CHAT, _lines_sql, any_of, chat

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Colleague' ELSE p_brand || CASE WHEN p_partkey % 2 = 1 THEN ' ' || p_type ELSE '' END || ' ' || p_name END || CASE WHEN p_size % 3 = 0 THEN ', MBTI INTJ' ELSE '' END AS identity FROM part""")
def identity_string(spark, sf_dir):
    k = F.col("p_partkey")
    profile = {"company": F.when(k % 4 > 0, F.col("p_brand")), "role": F.when(k % 2 == 1, F.col("p_type")).otherwise(""), "known_for": F.when(k % 4 > 0, F.col("p_name"))}
    profile["role"] = F.when(k % 4 > 0, profile["role"])
    return table(spark, sf_dir, "part").select("p_partkey", records.identity(profile, F.lit("Colleague"), F.when(F.col("p_size") % 3 == 0, "INTJ")).alias("identity"))


SLUG = "replace(lower(p_name), ' ', '_') || '_' || p_partkey"


@query(f"""SELECT p_partkey, 'colleague_' || s AS combined_name, 'colleague_' || s || '_work' AS work_name, 'colleague_' || s || '_persona' AS persona_name, 'colleague-' || replace(s, '_', '-') AS combined_command, 'colleague-' || replace(s, '_', '-') || '-work' AS work_command, 'colleague-' || replace(s, '_', '-') || '-persona' AS persona_command FROM (SELECT p_partkey, {SLUG} AS s FROM part)""")
def artifact_names(spark, sf_dir):
    slug = slugify(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in records.artifact_names(F.lit("colleague"), slug).items()])


#: Each part as a record's metadata: keys that are given, empty, null, misspelt, misplaced or of another type. Keys of
#: nested objects are in order.
META_JSON = """concat('{"a_custom":{"x":[1,2]}',
  CASE p_partkey % 5 WHEN 0 THEN ',"character":"Ex "' WHEN 1 THEN ',"type":"ICON"' WHEN 2 THEN ',"character":"","type":"nuwa"' WHEN 3 THEN '' ELSE ',"character":"robot"' END,
  CASE p_partkey % 3 WHEN 0 THEN concat(',"display_name":"', p_name, '"') WHEN 1 THEN ',"display_name":""' ELSE '' END,
  CASE p_partkey % 2 WHEN 0 THEN concat(',"name":"', p_brand, '"') ELSE '' END,
  CASE p_partkey % 11 WHEN 0 THEN concat(',"id":"own-', p_partkey, '"') WHEN 1 THEN ',"id":""' ELSE '' END,
  CASE p_partkey % 7 WHEN 0 THEN ',"source_context":{"domain":null,"note":"n"}' WHEN 1 THEN ',"source_context":{"domain":"own","is_fictional":true}' WHEN 2 THEN ',"source_context":"text"' ELSE '' END,
  CASE p_partkey % 4 WHEN 0 THEN ',"lifecycle":{"created_at":"2023-01-01","status":"retired","version":"v7"}' WHEN 1 THEN ',"created_at":"2023-02-02","version":""' WHEN 2 THEN ',"updated_at":"2023-03-03","version":"v2_before","lifecycle":{"status":null,"updated_at":"2022"}' ELSE '' END,
  CASE p_partkey % 6 WHEN 0 THEN ',"corrections_count":null,"generation":{"corrections_count":9}' WHEN 1 THEN ',"generation":{"corrections_count":4,"preset":"own.v9","research_profile":"budget-unfriendly"}' WHEN 2 THEN ',"corrections_count":2,"knowledge_sources":["k1","k2"]' WHEN 3 THEN ',"generation":{"character":"celebrity"}' ELSE '' END,
  CASE p_partkey % 8 WHEN 0 THEN ',"research_profile":" Budget_Unfriendly "' WHEN 1 THEN ',"engine":{"name":null,"research_profile":"budget-unfriendly"}' WHEN 2 THEN ',"research_profile":"other","engine":{"extra":[true],"merge_strategy":"mine"}' ELSE '' END,
  CASE p_partkey % 9 WHEN 0 THEN ',"tags":["t1","",3,"t2"]' WHEN 1 THEN ',"tags":{"culture":["c"],"personality":["calm",""]}' WHEN 2 THEN ',"classification":{"language":"zh-CN","tags":[]}' WHEN 3 THEN ',"classification":{"language":""}' ELSE '' END,
  CASE p_partkey % 10 WHEN 0 THEN ',"artifacts":{"work_doc":"w.md","z":1},"compat":{"legacy_type":"old"}' WHEN 1 THEN ',"kind":"kit","subtype":"s","summary":"own summary"' WHEN 2 THEN ',"profile":"  a text "' WHEN 3 THEN ',"profile":{"company":"Acme","mbti":"INTJ","role":""}' WHEN 4 THEN ',"profile":{},"preset":"mine"' ELSE '' END, '}')"""
NOW = "2024-01-02T03:04:05+00:00"
#: Presets as a user of their own might have them.
BUNDLES = metadata.Bundles(
    "loom", prompts={"celebrity": {"intake": "p/c.md"}}, profile_prompts={("celebrity", "budget-unfriendly"): {"audit": "p/a.md"}}, references={("celebrity", "budget-unfriendly"): ["r/1.md"]},
    tools={"celebrity": {"merge": "t/m"}}, runtimes=("one", "two"), installers={"one": "t/one"},
)


def metas(spark, sf_dir):
    """(slug, meta): each part's metadata with all defaults."""
    slug = slugify(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))
    rows = parts.select(slug.alias("slug"), F.parse_json(F.expr(META_JSON)).alias("meta"))
    return metadata.enriched(rows, metadata.preset_table(spark, BUNDLES), F.lit(NOW), BUNDLES.engine)


def _said(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(j->>'$.{p}', '')" for p in paths) + ")"


_SECTIONS = ["source_context", "classification", "artifacts", "engine", "generation", "lifecycle", "compat"]
_Q = lambda x: f"""'"' || {x} || '"'"""
_DEFAULTS = {
    "source_context": {"domain": _Q("CASE family WHEN 'colleague' THEN 'work' WHEN 'relationship' THEN 'personal' ELSE 'public' END"), "relationship_to_user": _Q("CASE family WHEN 'colleague' THEN 'coworker' WHEN 'relationship' THEN 'relationship' ELSE 'public_figure' END"), "is_real_person": "'true'", "is_public_figure": "(family = 'celebrity')::VARCHAR", "is_fictional": "'false'"},
    "classification": {"gallery_category": _Q("label"), "tags": """CASE k % 9 WHEN 0 THEN '["t1","t2"]' WHEN 1 THEN '["calm","c"]' ELSE '[]' END""", "language": _Q("'en'")},
    "artifacts": {k: _Q(f"'{v}'") for k, v in metadata.FILES.items()} | {f"{n}_{w}": _Q(x) for w, base, sep in (("name", "family || '_' || slug", "_"), ("command", "family || '-' || replace(slug, '_', '-')", "-")) for n, x in (("combined", base), ("work", f"{base} || '{sep}work'"), ("persona", f"{base} || '{sep}persona'"))},
    "compat": {"legacy_command": _Q("CASE family WHEN 'colleague' THEN '/create-colleague' WHEN 'relationship' THEN '/create-ex' ELSE '/create-icon' END"), "legacy_storage_root": _Q("CASE family WHEN 'colleague' THEN 'colleagues' ELSE 'skills/' || family END"), "legacy_type": _Q("family")},
    "lifecycle": {"status": _Q("'active'")},
}
_SHARED = {
    "character": _Q("family"), "research_profile": _Q("profile"), "preset": _Q("preset"),
    "prompt_bundle": """CASE family WHEN 'celebrity' THEN '{"intake":"p/c.md","preset":"celebrity.v1"}' ELSE '{"preset":"' || family || '.v1"}' END""",
    "research_profile_bundle": """CASE WHEN deep THEN '{"audit":"p/a.md"}' ELSE '{}' END""", "research_profile_references": """CASE WHEN deep THEN '["r/1.md"]' ELSE '[]' END""",
    "merge_strategy": _Q("CASE WHEN deep THEN 'deep' ELSE 'compact' END"), "quality_profile": _Q("CASE WHEN deep THEN 'budget-unfriendly' ELSE 'budget-friendly' END"),
    "knowledge_dirs": """CASE family WHEN 'celebrity' THEN '["docs","messages","emails","research/raw","research/merged","research/reviews","transcripts","subtitles"]' ELSE '["docs","messages","emails"]' END""",
    "storage_root": _Q("'skills/' || family"), "research_tools": """CASE family WHEN 'celebrity' THEN '{"merge":"t/m"}' END""",
}
_DEFAULTS["engine"] = _SHARED | {"name": _Q("'loom'"), "kind": _Q("'meta-skill'")}
_DEFAULTS["generation"] = _SHARED | {"engine": _Q("'loom'"), "created_from": "coalesce(j->'$.knowledge_sources', '[]')::VARCHAR"}
_FORCED = {"generation": {"corrections_count": "fixes"}, "lifecycle": {"created_at": _Q("created"), "updated_at": _Q("updated"), "version": _Q("version")}}
_TOP = {
    "schema_version": _Q("'3'"), "slug": _Q("slug"), "kind": _Q("kind"), "character": _Q("family"), "research_profile": _Q("profile"), "preset": _Q("preset"), "display_name": _Q("display"), "name": _Q(f"coalesce({_said('name')}, display)"),
    "id": _Q(f"coalesce({_said('id')}, kind || '.' || family || '.' || slug)"), "created_at": _Q("created"), "updated_at": _Q("updated"), "version": _Q("version"), "corrections_count": "fixes", "type": _Q(f"coalesce({_said('type')}, family)"),
    "summary": _Q(f"coalesce({_said('summary')}, display || ', ' || who)"),
}
_rows = lambda spec: ", ".join(f"{{sec: '{sec}', key: '{k}', value: ({v})::VARCHAR}}" for sec, keys in spec.items() for k, v in keys.items())
#: r: (slug, sec, key, value) of every member of every record; e: one row a record.
META_SQL = f"""m AS (SELECT p_partkey AS k, {SLUG} AS slug, {META_JSON}::JSON AS j FROM part), f AS (
  SELECT *, CASE WHEN c IN ('ex', 'self', 'yourself', 'relationship') THEN 'relationship' WHEN c IN ('icon', 'character', 'fictional-character', 'nuwa', 'celebrity') THEN 'celebrity' ELSE 'colleague' END AS family
  FROM (SELECT *, lower(trim({_said('character', 'type', 'generation.character')})) AS c FROM m)
), n AS (SELECT *, family = 'celebrity' AND coalesce(replace(lower(trim({_said('research_profile', 'generation.research_profile', 'engine.research_profile')})), '_', '-') = 'budget-unfriendly', false) AS deep, upper(family[1]) || family[2:] AS label FROM f
), e AS (SELECT *, CASE WHEN deep THEN 'budget-unfriendly' WHEN family = 'celebrity' THEN 'budget-friendly' ELSE 'standard' END AS profile, coalesce({_said('display_name', 'name')}, slug) AS display, coalesce({_said('kind')}, 'meta-skill') AS kind,
    coalesce({_said('preset', 'generation.preset')}, family || '.v1') AS preset, coalesce({_said('created_at', 'lifecycle.created_at')}, '{NOW}') AS created, coalesce({_said('updated_at', 'lifecycle.updated_at')}, {_said('created_at', 'lifecycle.created_at')}, '{NOW}') AS updated,
    coalesce({_said('version', 'lifecycle.version')}, 'v1') AS version, CASE WHEN list_contains(json_keys(j), 'corrections_count') THEN (j->'$.corrections_count')::VARCHAR ELSE coalesce((j->'$.generation.corrections_count')::VARCHAR, '0') END AS fixes,
    CASE k % 10 WHEN 2 THEN 'a text' WHEN 3 THEN 'Acme, MBTI INTJ' ELSE label END AS who, coalesce({_said('classification.language')}, 'en') LIKE 'zh%' AS zh FROM n
), given AS (SELECT slug, sec, key, json_extract(j, '$.' || CASE sec WHEN '' THEN '' ELSE sec || '.' END || key)::VARCHAR AS value FROM (
    SELECT slug, j, sec, unnest(CASE WHEN sec = '' THEN json_keys(j) WHEN json_type(j, '$.' || sec) = 'OBJECT' THEN json_keys(j, '$.' || sec) ELSE [] END) AS key FROM e, (SELECT unnest({['', *_SECTIONS]}) AS sec)) WHERE sec <> '' OR key NOT IN {tuple(_SECTIONS)}
), forced AS (SELECT slug, x.* FROM (SELECT slug, unnest([{_rows({'': _TOP} | _FORCED)}]) AS x FROM e)
), usual AS (SELECT slug, x.* FROM (SELECT slug, unnest([{_rows(_DEFAULTS | {'': {'subtype': "'null'"}})}]) AS x FROM e) WHERE x.value IS NOT NULL
), kept AS (SELECT * FROM given ANTI JOIN forced USING (slug, sec, key)), r AS (SELECT * FROM forced UNION ALL SELECT * FROM kept UNION ALL SELECT * FROM (SELECT * FROM usual ANTI JOIN forced USING (slug, sec, key)) ANTI JOIN kept USING (slug, sec, key)
), o AS (SELECT slug, sec, '{{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}}' AS text FROM r WHERE sec <> '' GROUP BY ALL
), whole AS (SELECT slug, '{{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}}' AS text FROM (SELECT slug, key, value FROM r WHERE sec = '' UNION ALL SELECT slug, sec, text FROM o) GROUP BY slug
), a AS (SELECT slug, any_value(value) FILTER (key = 'work_doc') AS work_doc FROM r WHERE sec = 'artifacts' GROUP BY slug)"""


def _sections_of(rows):
    """(slug, section, key, value) of each member of the records in ``meta``, values as JSON."""
    entries = lambda v, sec: F.transform(F.map_entries(metadata.members(v)), lambda e: F.struct(F.lit(sec).alias("section"), e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
    inner = [entries(F.try_variant_get("meta", f"$.{s}", "variant"), s) for s in _SECTIONS]
    top = F.filter(entries(F.col("meta"), ""), lambda e: ~e["key"].isin(_SECTIONS))
    return rows.select("slug", F.explode(F.concat(top, *inner)).alias("e")).select("slug", "e.*")


@query(f"WITH {META_SQL} SELECT slug, sec AS section, key, value FROM r")
def meta_enrich(spark, sf_dir):
    """Every member of each part's metadata after all defaults."""
    return _sections_of(metas(spark, sf_dir))


_COMMAND = "family || '-' || replace(slug, '_', '-')"
MANIFEST = f"""'{{"artifacts":["SKILL.md",' || a.work_doc || ',"persona.md","meta.json","manifest.json"],"capabilities":["persona","work"],"character":"' || family || '","display_name":"' || display || '","engine":' || o.text
  || ',"entrypoints":{{"default":"SKILL.md","persona":"persona_skill.md","work":"work_skill.md"}},"id":' || i.value || ',"install":{{"compatible_runtimes":["one","two"],"installers":{{"one":"t/one"}},"min_schema_version":"3","slash_commands":{{"default":"' || {_COMMAND} || '","persona":"' || {_COMMAND} || '-persona","work":"' || {_COMMAND} || '-work"}}}}'
  || ',"kind":"' || kind || '","manifest_version":"1","preset":"' || preset || '","research_profile":"' || profile || '","toolchain":' || t.text || '}}'"""
_TOOLCHAIN = "knowledge_dirs merge_strategy prompt_bundle quality_profile research_profile research_profile_bundle research_profile_references research_tools".split()
_MANIFESTS = f"""t AS (SELECT slug, '{{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}}' AS text FROM (SELECT slug, key, value FROM r WHERE sec = 'engine' AND key IN {tuple(_TOOLCHAIN)} UNION ALL SELECT slug, 'research_tools', '{{}}' FROM e WHERE family <> 'celebrity') GROUP BY slug
), manifests AS (SELECT slug, {MANIFEST} AS manifest FROM e JOIN a USING (slug) JOIN (SELECT slug, text FROM o WHERE sec = 'engine') o USING (slug) JOIN t USING (slug) JOIN (SELECT slug, value FROM r WHERE sec = '' AND key = 'id') i USING (slug))"""


@query(f"WITH {META_SQL}, {_MANIFESTS} SELECT * FROM manifests")
def manifest(spark, sf_dir):
    """Each record's whole manifest."""
    return metas(spark, sf_dir).select("slug", F.to_json(metadata.manifest_of(F.col("meta"), BUNDLES)).alias("manifest"))


def _filled_sql(template: str, values: dict[str, str]) -> str:
    quoted = [f"'{x.replace(chr(39), chr(39) * 2)}'" if k % 2 == 0 else values[x] for k, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return " || ".join(quoted)


_VALUES = {"combined_name": "family || '_' || slug", "description": "summary", "display_name": "display", "identity": "who", "work_content": "'work of ' || slug", "persona_content": "'persona {of} ' || slug"}
_FRONT = "'---' || chr(10) || 'name: ' || family || '_' || slug || '_{kind}' || chr(10) || 'description: ' || display || CASE WHEN zh THEN '{cn}' ELSE '{en}' END || chr(10) || 'user-invocable: true' || chr(10) || '---' || chr(10) || chr(10) || {body} || chr(10)"


@query(f"""WITH {META_SQL}, {_MANIFESTS}, w AS (SELECT e.*, coalesce({_said('summary')}, display || ', ' || who) AS summary, trim(a.work_doc, '"') AS work_doc, whole.text AS meta, manifests.manifest AS manifest FROM e JOIN a USING (slug) JOIN whole USING (slug) JOIN manifests USING (slug))
  SELECT slug, file, content FROM (SELECT slug, unnest([work_doc, 'persona.md', 'SKILL.md', 'work_skill.md', 'persona_skill.md', 'manifest.json', 'meta.json']) AS file, unnest(['work of ' || slug, 'persona {{of}} ' || slug, CASE WHEN zh THEN {_filled_sql(records.COMBINED_ZH, _VALUES)} ELSE {_filled_sql(records.COMBINED_EN, _VALUES)} END,
  {_FRONT.format(kind="work", cn=" 的工作能力（仅 Work，无 Persona）", en=" work capability only (without persona)", body="'work of ' || slug")}, {_FRONT.format(kind="persona", cn=" 的人物性格（仅 Persona，无工作能力）", en=" persona only (without work capability)", body="'persona {of} ' || slug")},
  manifest, meta]) AS content FROM w)""")
def skill_render(spark, sf_dir):
    """All seven artifacts of each record."""
    return rendered(metas(spark, sf_dir))


def rendered(rows):
    """(slug, file, content) of records' artifacts, with made-up work and persona texts."""
    f, names = metadata.fields_of(F.col("meta")), metadata.files_of(F.col("meta"))
    work, persona = F.concat(F.lit("work of "), "slug"), F.concat(F.lit("persona {of} "), "slug")
    return records.artifacts(rows, names, names, f["display_name"], metadata.identity_of(F.col("meta"), f["label"]), f["summary"], f["language"], work, persona, F.to_json(metadata.manifest_of(F.col("meta"), BUNDLES)), F.to_json("meta"), ["slug"])


@query(f"""WITH {META_SQL} SELECT slug, '{{"host":"h' || (length(slug) % 3) || '","command_name":"' || {_COMMAND} || '","character":"' || family || '","slug":"' || slug || '","version":"' || version || '","source_skill_dir":"skills/' || family || '/' || slug || '","source_artifact":"SKILL.md","installed_at":"2024-03-01T00:00:00+00:00"}}' AS record FROM e""")
def install_records(spark, sf_dir):
    f, names = metadata.fields_of(F.col("meta")), metadata.files_of(F.col("meta"))
    host = F.concat(F.lit("h"), (F.length("slug") % 3).cast("string"))
    record = records.install_record(host, names["combined_command"], f, F.concat(f["storage_root"], F.lit("/"), "slug"), names["combined_skill"], F.lit("2024-03-01T00:00:00+00:00"))
    return metas(spark, sf_dir).select("slug", record.alias("record"))


@query("""SELECT p_partkey, k, v FROM (SELECT p_partkey, unnest(map_entries(m)) AS e FROM (SELECT p_partkey, map_concat(MAP {'brand': 'none', 'size': '1', 'tone': 'calm'}, CASE p_partkey % 3 WHEN 0 THEN MAP {'size': p_size || '', 'brand': NULL} WHEN 1 THEN MAP {'brand': p_brand, 'kind': p_type} ELSE MAP {}::MAP(VARCHAR, VARCHAR) END) AS m FROM part)), LATERAL (SELECT e.key AS k, e.value AS v)""")
def dict_merge(spark, sf_dir):
    """Given values over defaults, key by key."""
    text = lambda c: c.cast("string")
    defaults = F.create_map(*map(F.lit, ("brand", "none", "size", "1", "tone", "calm")))
    k = F.col("p_partkey") % 3
    given = F.when(k == 0, F.create_map(F.lit("size"), text(F.col("p_size")), F.lit("brand"), F.lit(None).cast("string"))).when(k == 1, F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(records.merged(defaults, given)).alias("k", "v"))


@query(f"""WITH {META_SQL} SELECT slug, kind, family AS character, profile AS research_profile, display AS name, who AS identity, version, updated AS updated_at, try_cast(fixes AS BIGINT) AS corrections_count FROM e WHERE length(slug) % 6 > 0""")
def skill_list(spark, sf_dir):
    """Records as JSON texts, of which a sixth is cut off and can't be read, read, filled in again and listed."""
    json = F.to_json("meta")
    stored = metas(spark, sf_dir).select("slug", F.when(F.length("slug") % 6 == 0, F.substring(json, F.lit(1), F.length(json) - 2)).otherwise(json).alias("value"))
    read = records.parsed_records(stored, "slug", "slug string").select(F.col("folder"))
    sound = stored.join(read, F.col("slug") == F.col("folder"), "left_semi").select("slug", F.try_parse_json("value").alias("meta"))
    return metadata.listed(metadata.enriched(sound, metadata.preset_table(spark, BUNDLES), F.lit("never"), BUNDLES.engine))


ORDERED = "(SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"


@query(f"SELECT o_custkey, string_agg('v' || n, ',' ORDER BY 'v' || n) AS versions FROM {ORDERED} GROUP BY o_custkey")
def version_list(spark, sf_dir):
    rows = records.chain(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("version")), ",").alias("versions"))


@query(f"SELECT o_custkey, o_orderkey, 'v' || n AS version, CASE WHEN n > 1 THEN 'v' || (n - 1) END AS archived, 'v' || (n + 1) AS next FROM {ORDERED}")
def version_chain(spark, sf_dir):
    rows = records.chain(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", "version", "archived", records.next_version(F.col("version")).alias("next"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 10")
def version_retention(spark, sf_dir):
    return records.retained(table(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query(f"""WITH v AS (SELECT o_custkey, n AS seq, 'v' || n AS version, 'b' || o_orderkey AS body FROM {ORDERED}), l AS (SELECT o_custkey, max(seq) AS seq, arg_max(version, seq) AS version, arg_max(body, seq) AS body, max(body) FILTER (version = 'v2') AS old FROM v GROUP BY o_custkey HAVING old IS NOT NULL)
  SELECT * FROM v UNION ALL SELECT o_custkey, seq + 1, version || '_before_rollback', body FROM l UNION ALL SELECT o_custkey, seq + 2, 'v2_restored', old FROM l""")
def version_rollback(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", n.alias("seq"), F.concat(F.lit("v"), n.cast("string")).alias("version"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("body"))
    return records.rolled_back(rows, "o_custkey", "v2")


def drafts(spark, sf_dir):
    """Each part's document of three sections, and a patch of one that may exist and a new one."""
    k = F.col("p_partkey").cast("string")
    old = F.concat(F.lit("# Top\n\n## A\n\none "), k, F.lit("\n\n## B\n\ntwo\n\n## C\n\nthree"))
    new = F.concat(F.lit("lost\n\n## "), F.element_at(F.array(*map(F.lit, "ABX")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit("\n\n"), F.when(F.col("p_partkey") % 2 == 0, "two").otherwise("fresh"), F.lit("\n\n## Z\n\nlast"))
    parts = table(spark, sf_dir, "part").select("p_partkey", old.alias("old"), new.alias("new"))
    return records.patched(records.sections(parts, "p_partkey", "old"), records.sections(parts, "p_partkey", "new"), "p_partkey")


PATCH_SQL = "x AS (SELECT p_partkey AS k, ['A', 'B', 'X'][(p_partkey % 3 + 1)::INT] AS h, CASE WHEN p_partkey % 2 = 0 THEN 'two' ELSE 'fresh' END AS b FROM part)"


@query(f"""WITH {PATCH_SQL} SELECT k AS p_partkey, array_to_string(['# Top', '## A', CASE WHEN h = 'A' THEN b ELSE 'one ' || k END, '## B', CASE WHEN h = 'B' THEN b ELSE 'two' END, '## C', 'three'] || CASE WHEN h = 'X' THEN ['## X', b] ELSE [] END || ['## Z', 'last'], chr(10) || chr(10)) AS text FROM x""")
def section_patch_merge(spark, sf_dir):
    return records.joined_sections(drafts(spark, sf_dir), "p_partkey")


@query(f"""WITH {PATCH_SQL} SELECT status, count(*) AS n FROM (SELECT unnest(['kept', CASE WHEN h = 'A' THEN 'replaced' ELSE 'kept' END, CASE WHEN h = 'B' THEN CASE b WHEN 'two' THEN 'confirmed' ELSE 'replaced' END ELSE 'kept' END, 'kept', 'appended'] || CASE WHEN h = 'X' THEN ['appended'] ELSE [] END) AS status FROM x) GROUP BY status""")
def delta_status(spark, sf_dir):
    return drafts(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'P' || chr(10) || chr(10) || '## Correction Log' || l2 || l1 || chr(10) || 'tail' WHEN 1 THEN 'P' || chr(10) || chr(10) || '## Correction Log' || l2 || l1 ELSE 'P' || chr(10) || chr(10) || '## Correction Log' || l2 || chr(10) || l1 || chr(10) END AS persona
  FROM (SELECT p_partkey, chr(10) || '- [general] should not a' || p_size || '; should ' || p_type AS l1, chr(10) || '- [mail] should not b; should c' AS l2 FROM part)""")
def correction_apply(spark, sf_dir):
    base = F.when(F.col("p_partkey") % 3 == 0, "P\n\n## Correction Log\n\n(No entries yet)\ntail").when(F.col("p_partkey") % 3 == 1, "P\n\n## Correction Log").otherwise("P")
    json = F.concat(F.lit('[{"wrong":"a'), F.col("p_size").cast("string"), F.lit('","correct":"'), F.col("p_type"), F.lit('"},{"scene":"mail","wrong":"b","correct":"c"}]'))
    return table(spark, sf_dir, "part").select("p_partkey", records.apply_corrections(base, nested.corrections(json)).alias("persona"))


@query("""SELECT role, '{"name":"' || role || '","channels":[' || string_agg(DISTINCT '"ch' || (conv_id % 3) || '"', ',' ORDER BY '"ch' || (conv_id % 3) || '"') || '],"messages":' || count(*) || '}' AS summary FROM conversations GROUP BY role""")
def collection_summary(spark, sf_dir):
    channel = F.concat(F.lit("ch"), (F.col("conv_id") % 3).cast("string"))
    rows = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sort_array(F.collect_set(channel)).alias("channels"), F.count(F.lit(1)).alias("messages"))
    return rows.select("role", F.to_json(F.struct(F.col("role").alias("name"), "channels", "messages")).alias("summary"))


@query(r"""SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[^\s!-/:-@\[-`{-~]+')) AS term FROM documents) GROUP BY ALL HAVING n >= 3""")
def frequent_terms(spark, sf_dir):
    return style.frequent_terms(table(spark, sf_dir, "documents"), "lang", "text")


@query(r"""SELECT role, CASE WHEN n < 15 THEN 'short' WHEN n <= 40 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM (SELECT role, length(trim(s)) AS n FROM (SELECT role, unnest(string_split_regex(text, '[.!?。！？\n]+')) AS s FROM conversations) WHERE trim(s) <> '') GROUP BY ALL""")
def sentence_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.explode(style.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("role", style.sentence_bucket(F.length("s")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT lang, sum(len(regexp_extract_all(text, '[!?…！？]')))::BIGINT AS marks, sum(len(regexp_extract_all(text, '(?i)\b(but|however|anyway|mais|aber|pero)\b')))::BIGINT AS turns, sum(len(regexp_extract_all(text, '[,.;:]')))::BIGINT AS stops, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang""")
def style_profile(spark, sf_dir):
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(n("[!?…！？]").alias("marks"), n(r"(?i)\b(but|however|anyway|mais|aber|pero)\b").alias("turns"), n("[,.;:]").alias("stops"), F.sum(F.length("text")).alias("chars"))


_TIERS = f"SELECT role, seq, conv_id, turn, content, CASE WHEN length(content) > {{n}} THEN 'long' WHEN regexp_matches({{c}}, '{{words}}') THEN 'decision' ELSE 'daily' END AS tier FROM {CHAT}"
CHAT_TITLES = [("long", "Long messages"), ("decision", "Decisions"), ("daily", "Daily talk")]


def _tier_sql(n: int, c: str, words, line: str, cap: int, head: str) -> str:
    sections = [(("", "---", "", f"## {title}", ""), f"tier = '{t}'", line, "''", cap if t == "daily" else None, False) for t, title in CHAT_TITLES]
    return _lines_sql(_TIERS.format(n=n, c=c, words=any_of(words)), "role", [f"'{head}' || role", "'total: ' || total"], sections)


@query(_tier_sql(50, "content", classify.CHAT_DECISIONS, "'[' || turn || '] ' || content", 100, "# Messages of "))
def chat_report(spark, sf_dir):
    """Each role's messages by tier, whole texts, as rows of a report."""
    rows = chat(spark, sf_dir).withColumn("tier", classify.message_tier(F.col("content")))
    head = [F.concat(F.lit("# Messages of "), "role"), F.concat(F.lit("total: "), F.col("total").cast("string"))]
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "content")
    return report.report_lines(rows, "role", head, report.tier_sections(CHAT_TITLES, line, {"daily": 100}))


@query(_tier_sql(200, "lower(content)", classify.MAIL_DECISIONS, "'**s' || conv_id || '**：' || substr(content, 1, 200)", 30, "# Mails of "))
def mail_report(spark, sf_dir):
    """Each role's mails by tier; a line shows 200 characters of a body, as the report has it."""
    rows = chat(spark, sf_dir).withColumn("tier", classify.mail_tier(F.col("content")))
    head = [F.concat(F.lit("# Mails of "), "role"), F.concat(F.lit("total: "), F.col("total").cast("string"))]
    line = F.concat(F.lit("**s"), F.col("conv_id").cast("string"), F.lit("**："), F.substring("content", 1, 200))
    return report.report_lines(rows, "role", head, report.tier_sections(CHAT_TITLES, line, {"daily": 30}))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, least(n, 50) AS kept, 3 + n AS corrections_count, 'o' || last AS newest FROM c JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY o_custkey) USING (o_custkey)""")
def correction_log(spark, sf_dir):
    """Each customer's orders as corrections to one log: the counter grows by all, the newest 50 stay."""
    entry = F.struct(F.col("o_orderkey").alias("k"), F.lit("s").alias("scene"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("wrong"), F.lit("x").alias("correct"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("cs"))
    items = F.transform("cs", lambda c: F.struct(c["scene"].alias("scene"), c["wrong"].alias("wrong"), c["correct"].alias("correct")))
    persona = records.newest_corrections(records.apply_corrections(F.lit("P\n\n## Correction Log"), items))
    out = rows.select("o_custkey", records.corrections_count(F.lit(3), items).alias("corrections_count"), F.filter(F.split(persona, "\n"), lambda x: x.startswith("- [")).alias("log"))
    return out.select("o_custkey", F.size("log").cast("long").alias("kept"), "corrections_count", F.regexp_extract(F.get("log", F.lit(0)), "not (o[0-9]+);", 1).alias("newest"))
