"""Union-typed JSON, rich text, grids, tags and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_cell, or_empty


#: JSON of what counts as nothing.
_NOTHING = r'^(?:null|""|false|\[\]|\{\}|-?0(?:\.0+)?(?:[eE][+-]?\d+)?)$'


def truthy(value: Column) -> Column:
    """The variant, or null if it is missing or one of null, false, 0, "", [] and {}."""
    return F.when(~F.to_json(value).rlike(_NOTHING), value)


def first_of(value: Column, keys) -> Column:
    """The first truthy variant under the keys of an object; null if there is none or it isn't an object."""
    return F.coalesce(*[truthy(F.try_variant_get(value, f"$.{k}", "variant")) for k in keys])


def plain(value: Column) -> Column:
    """The variant as text: a string itself, anything else in JSON; empty for null."""
    return or_empty(F.try_variant_get(value, "$", "string"))


def text_of(value: Column, keys=("text", "content")) -> Column:
    """Text of a variant: a string as it is, an object's first truthy key, a list's parts joined by spaces.

    What counts is the value's own type, so a string that begins with a bracket stays a string.
    """
    is_list, is_object = F.schema_of_variant(value).startswith("ARRAY"), F.schema_of_variant(value).startswith("OBJECT")
    inner = F.when(is_object, F.coalesce(first_of(value, keys), value)).otherwise(value)
    part = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), or_empty(F.try_variant_get(x, "$.text", "string"))).otherwise(plain(x))
    joined = lambda v: F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), " ")
    inner_list = F.schema_of_variant(inner).startswith("ARRAY")
    return F.when(is_list | inner_list, or_empty(joined(inner))).otherwise(plain(inner))


def message_fields(value: Column, spec: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """name -> the text of the first truthy of its keys, empty without one. value: a variant that holds an object."""
    return {name: plain(first_of(value, keys)) for name, keys in spec.items()}


def rich_text(body: Column) -> Column:
    """Text of ``{"text": …}``, or the text and link segments of ``{"content": [[…]]}`` joined by spaces."""
    plain = F.get_json_object(body, "$.text")
    rows = F.from_json(F.get_json_object(body, "$.content"), "array<array<struct<tag:string,text:string>>>")
    parts = F.filter(F.flatten(rows), lambda s: s["tag"].isin("text", "a") & (or_empty(s["text"]) != ""))
    return F.coalesce(plain, F.array_join(F.transform(parts, lambda s: s["text"]), " "), F.lit(""))


def markdown_row(fields: Column, values: Column) -> Column:
    """One table row: a map's values by field, in the fields' order; a missing one is empty."""
    cells = F.transform(fields, lambda f: markdown_cell(or_empty(F.element_at(values, f))))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_head(fields: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(fields, " | "), F.lit(" |\n|"), F.array_join(F.transform(fields, lambda f: F.lit(" --- ")), "|"), F.lit("|"))


def dense_csv(cells: DataFrame, grid: str, row: str, col: str, value: str) -> DataFrame:
    """(grid, row, line): each row's cells from the grid's first column to its last, quoted, holes empty.

    Quotes within a cell stay as they are.
    """
    width = cells.groupBy(grid).agg(F.max(col).alias("__last"))
    rows = cells.groupBy(grid, row).agg(F.map_from_entries(F.collect_list(F.struct(col, value))).alias("__m")).join(width, grid)
    line = F.transform(F.sequence(F.lit(0), F.col("__last").cast("int")), lambda c: F.concat(F.lit('"'), or_empty(F.element_at("__m", c.cast(cells.schema[col].dataType))), F.lit('"')))
    return rows.select(grid, row, F.array_join(line, ",").alias("line"))


def flat_tags(classified: Column, listed: Column, personality: Column, culture: Column) -> Column:
    """The classification's tags, else listed tags, else personality and culture tags together; blanks dropped."""
    some = lambda x: F.when(F.size(F.coalesce(x, F.array().cast("array<string>"))) > 0, x)
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(personality, none), F.coalesce(culture, none))
    return F.filter(F.coalesce(some(classified), some(listed), both), lambda x: or_empty(x) != "")


def corrections(json: Column) -> Column:
    """array<struct<scene,wrong,correct>> of a single correction, a list, or a wrapped list."""
    item = "struct<scene:string,wrong:string,correct:string>"
    single = F.from_json(json, item)
    wrapped = F.coalesce(F.get_json_object(json, "$.persona_corrections"), F.get_json_object(json, "$.corrections"))
    both = lambda x: x["wrong"].isNotNull() & x["correct"].isNotNull()
    whole = F.when(json.startswith("["), F.from_json(json, f"array<{item}>")).when(both(single), F.array(single)).otherwise(F.filter(F.from_json(wrapped, f"array<{item}>"), both))
    return F.transform(F.coalesce(whole, F.array().cast(f"array<{item}>")), lambda c: F.struct(F.coalesce(c["scene"], F.lit("general")).alias("scene"), c["wrong"].alias("wrong"), c["correct"].alias("correct")))
