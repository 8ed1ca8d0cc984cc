"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``rate = target / source size`` times. Documents of a source
are put in an order (size class, hash of the id, size, id), the expected copies are prefix-summed along it,
one random offset per source is added, and a document is emitted once for each integer boundary its
interval crosses. So a document gets floor(rate) or ceil(rate) copies, and each stretch of similar
sizes gets its share.

The prefix sum is not one window over a source, which may hold a third of all rows: the order's
leading part makes buckets, a size class and a range of hashes, that are counted with map-side combine;
offsets are summed over buckets, and positions within a bucket by a window on the bucket. How many ranges there
are follows the number of rows, but not the order, so it decides nothing about any document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD

#: Ranges of hashes that one size class of one source is dealt to, at least; and rows of a bucket, at most about.
RANGES, BUCKET_ROWS = 64, 500_000
#: Size classes to each doubling of the size.
CLASSES_PER_DOUBLING = 4
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _hex_int(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def offset_of(source: Column, seed: int) -> Column:
    """The source key's random offset in [0, 1), the same in every run."""
    return _hex_int(F.concat(F.lit(f"{seed}:"), source), 8) / F.lit(2.0**32)


def _source_key(source: Column) -> Column:
    """Never null, in the order of the source's code points, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(__source, source_size, target) from one (__source, size) row or several per source.

    Targets share ``share`` of all sizes by weight; none exceeds ``cap`` times its source's size, and
    what it leaves is shared again by weight among the others. Closed form: in the order of
    cap * size / weight, the first source whose level fits fixes the level of all that follow.
    """
    per = sizes.groupBy("__source").agg(F.sum("size").cast("double").alias("__size"))
    turn = (F.row_number().over(Window.orderBy("__source")) - 1) % len(weights) + 1
    per = per.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    per = per.withColumn("__ratio", cap * F.col("__size") / F.col("__w"))
    before = Window.orderBy("__ratio", "__source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__ratio", "__source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(cap * F.col("__size")).over(before), F.lit(0.0))
    gone = F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    level = (share * F.sum("__size").over(every) - capped) / (F.sum("__w").over(every) - gone)
    per = per.withColumn("__level", level)
    fits = F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__source", "__level"))
    per = per.withColumn("__level", F.min(fits).over(every)["__level"])
    most = cap * F.col("__size")
    target = F.least(most, F.coalesce(F.col("__w") * F.col("__level"), most))
    return per.select("__source", F.col("__size").cast("long").alias("source_size"), target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with ``size, source_size, target, copies`` added (or replaced, where docs has such columns).

    A null text has size 0 and a null source is a source of its own, last in the order of weights.
    A source without words has target 0 and no copies. Repeated rows are sampled each on its own; rows of
    one id and size are ordered by a hash of their text, where there is one, so reruns agree on each row.
    Rows without an id are dealt to buckets by their text. Long texts are counted whole. An empty table
    gives an empty result.

    The number of buckets grows with the rows, so that one class of one source, were it to hold all rows,
    is still ordered in parts of BUCKET_ROWS; the result is the same with any number. Sources are ranked in one task; there are far fewer than rows.
    """
    size = word_count(F.col("text")) if size is None else size
    own = ("size", "source_size", "target", "copies")
    docs = docs.select(*[c for c in docs.columns if c not in own], size.cast("long").alias("size"))
    keys = ["__source", "__class", "__range"]
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    ranges = max(RANGES, docs.count() // BUCKET_ROWS)
    by_text = [F.hex(text)] if "text" in docs.columns else []
    rows = docs.withColumns({
        "__source": _source_key(F.col("source")),
        "__class": F.floor(F.log2(F.col("size") + F.lit(1.0)) * CLASSES_PER_DOUBLING).cast("int"),
        "__hash": _hex_int(F.coalesce(F.col("doc_id").cast("string"), *by_text, F.lit("")), 8),
    })
    rows = rows.withColumn("__range", F.floor(F.col("__hash") * ranges / 2**32).cast("int"))
    buckets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("__source").orderBy("__class", "__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(*keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    offsets = offsets.join(source_targets(buckets, weights, share, cap), "__source")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__hash", "size", F.col("doc_id").asc_nulls_last(), text))
    rows = rows.withColumn("__place", place).join(offsets, keys)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, u = F.col("__before") + F.col("__place"), offset_of(F.col("__source"), seed)
    copies = F.floor(at * rate + u) - F.floor((at - 1) * rate + u)
    return rows.select(*docs.columns, "source_size", "target", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 0 in column ``copy``."""
    some = mixed.where("copies > 0")
    return some.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
