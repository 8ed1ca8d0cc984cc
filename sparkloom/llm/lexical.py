"""Ranked lexical search by a threshold-seeded join over an inverted index.

The index holds a posting for each document and query term: how often the term stands there. With it each term
stores its largest and its kth largest impact, that is, what one occurrence in a query adds to a score. k documents
score at least a term's kth impact, so the largest of these is a lower bound of an item's kth score. An item's terms
are put in order of their largest impact; a term from which on the largest impacts together stay under the bound is
pruned, as documents that hold only such terms can't be among the k. Postings of the other terms give candidates
with partial scores, whose kth largest raises the bound; candidates that can't reach it with all that the pruned
terms could add go, and the rest are scored exactly over all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, arrow_rows, cut, written

#: Documents that an item gets.
K = 10
#: Texts that a worker gets at once.
BATCH_ROWS = 1_000


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text and distinct term, then one without a term for the whole partition: texts with terms, and terms."""
    texts = terms = 0
    for b in batches:
        row, key, term, tf, size = [], [], [], [], []
        for r, k, text in zip(b["row"].tolist(), b["key"].tolist(), b["text"].tolist()):
            words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if isinstance(text, str) else []
            if words:
                counts = Counter(words)
                texts, terms = texts + 1, terms + len(words)
                row += [r] * len(counts)
                key += [k] * len(counts)
                term += counts.keys()
                tf += counts.values()
                size += [len(words)] * len(counts)
        yield pd.DataFrame({"row": row, "key": pd.Series(key, dtype="Int64"), "term": pd.Series(term, dtype=object), "tf": tf, "n": size})
    yield pd.DataFrame({"row": [-1], "key": pd.Series([None], dtype="Int64"), "term": pd.Series([None], dtype=object), "tf": [terms], "n": [texts]})


def counted(texts: DataFrame, key: str) -> DataFrame:
    """(row, key, term, tf, n): the distinct terms of each row's text, with the text's terms in all."""
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), "text")
    return rows.mapInPandas(_counted, "row long, key long, term binary, tf long, n long")


def weight(df: Column, n_texts: int) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0 * n_texts + 2)) / (2 * df + 1))).cast("long")


def impact(tf: Column, n: Column, w: Column, n_texts: int, n_terms: int) -> Column:
    """What one occurrence of the term in a query adds to the text's score."""
    m = F.lit(25).cast("long") + F.call_function("div", F.lit(75).cast("long") * n * F.lit(n_texts).cast("long"), F.lit(max(n_terms, 1)).cast("long"))
    return w * F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(8).cast("long") * m)


def term_bounds(postings: DataFrame, k: int = K) -> DataFrame:
    """(tid, most, kth): each term's largest impact, and its kth largest, 0 with fewer documents.

    The cut to k rows is a literal, so Spark makes it before the shuffle and no task gets a common term's postings.
    """
    place = F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("impact")))
    top = postings.select("tid", "impact").withColumn("place", place).where(F.col("place") <= k)
    return top.groupBy("tid").agg(F.max("impact").alias("most"), F.max(F.when(F.col("place") == k, F.col("impact")).otherwise(0)).alias("kth"))


def planned(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """(item, tid, q, needed, least, rest) of each item's terms that stand in any document.

    least: the item's lower bound; needed: whether the term's postings must be read; rest: what all other terms
    together can add at most. queries: (item, tid, q).
    """
    of_item = Window.partitionBy("item")
    falling = of_item.orderBy(F.desc("bound"), "tid")
    rows = queries.join(bounds, "tid").withColumn("bound", F.col("q") * F.col("most"))
    rows = rows.withColumn("least", F.max(F.col("q") * F.col("kth")).over(of_item))
    rows = rows.withColumn("suffix", F.sum("bound").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("needed", (F.col("suffix") >= F.col("least")) & (F.col("bound") > 0))
    rows = rows.withColumn("rest", F.sum(F.when(~F.col("needed"), F.col("bound")).otherwise(0)).over(of_item))
    return rows.select("item", "tid", "q", "needed", "least", "rest")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(item, kth): the kth largest score of each item that has as many."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    return scores.select("item", "score").withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("item", F.col("score").alias("kth"))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of highest score above 0, the best first.

    docs: doc_id, text; items: item_id, text. Equal scores go by ascending doc_id, null last. Rows that repeat an id,
    or have none, are documents and items of their own. Null, empty and wordless texts are in no result and not in the
    collection's counts; long texts are read whole; other columns are not looked at. No documents or items, no rows.

    The index and the candidates are written in the shared folder. Terms of items are joined as Spark finds best by
    their written size; common terms' postings are many rows of one key, which AQE splits when both sides are dealt.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        asked = written(counted(items, "item_id").where("term IS NOT NULL").select(F.col("row").alias("item"), F.col("key").alias("item_id"), "term", F.col("tf").alias("q")), "asked")
        vocabulary = written(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")
        index = counted(docs, "doc_id").join(vocabulary, "term", "left").where("tid IS NOT NULL OR term IS NULL")
        index = written(index.select("row", F.col("key").alias("doc_id"), "tid", "tf", "n"), "index")
    totals = index.where("tid IS NULL").agg(F.sum("n").alias("texts"), F.sum("tf").alias("terms")).first()
    n_texts, n_terms = totals.texts or 0, totals.terms or 0
    found = index.where("tid IS NOT NULL")
    weights = written(found.groupBy("tid").agg(F.count(F.lit(1)).alias("df")).select("tid", weight(F.col("df"), n_texts).alias("w")), "weights")
    scored = lambda rows: rows.join(weights, "tid").withColumn("impact", impact(F.col("tf"), F.col("n"), F.col("w"), n_texts, n_terms))
    queries = asked.join(vocabulary, "term").select("item", "tid", "q")
    plan = written(planned(queries, term_bounds(scored(found), k)), "plan")
    hits = scored(found).join(plan.where("needed").select("item", "tid", "q"), "tid")
    partial = written(hits.groupBy("item", "row").agg(F.sum(F.col("q") * F.col("impact")).alias("score")), "partial")
    limits = plan.groupBy("item").agg(F.max("least").alias("least"), F.max("rest").alias("rest")).join(_kth(partial, k), "item", "left")
    limits = written(limits.select("item", "rest", F.greatest("least", F.coalesce("kth", F.lit(0))).alias("least")), "limits")
    candidates = written(partial.join(limits, "item").where(F.col("score") + F.col("rest") >= F.col("least")).select("item", "row"), "candidates")
    read = scored(found.join(candidates.select("row").distinct(), "row", "left_semi")).select("row", "doc_id", "tid", "impact")
    exact = candidates.join(read, "row").join(plan.select("item", "tid", "q"), ["item", "tid"])
    exact = exact.groupBy("item", "row", "doc_id").agg(F.sum(F.col("q") * F.col("impact")).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    best = exact.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
