"""Selecting rows: targets, memberships, scored lookups, fallbacks, caps and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..sources.scratch import scratch_folder


def from_target(sender: Column, target: str, ignore_case: bool = False) -> Column:
    """Whether the sender's name holds the target; an empty target keeps all."""
    s = or_empty(sender)
    return F.lower(s).contains(target.lower()) if ignore_case else s.contains(target)


def shared_channels(channels: DataFrame, members: DataFrame, user: str, key: str = "channel_id", order=("channel_id",), most: int | None = 50, ids=("member_id",), joined: str = "is_member") -> DataFrame:
    """Of the first ``most`` channels that are joined, those that the user is a member of, by any of the id columns.

    The cap comes before the membership test, as each test costs a request where members are asked for.
    """
    mine = members.where(F.array_contains(F.array(*[F.col(i).cast("string") for i in ids]), user))
    open_ = channels.where(F.coalesce(F.col(joined), F.lit(False)))
    first = open_ if most is None else open_.orderBy(*order).limit(most)
    return first.join(mine.select(key).distinct(), key, "left_semi")


def with_detail(hits: DataFrame, details: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """hits with columns of the detail row where there is one, else the hit's own. columns: hit -> detail."""
    right = details.select(F.col(key).alias("__k"), *[F.col(d).alias(f"__{h}") for h, d in columns.items()])
    joined = hits.join(right, hits[key] == F.col("__k"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in hits.columns])


def match_score(query: str, real: Column, display: Column, user: Column) -> Column:
    """3: equals one of the names; 2: stands in one; 1: each character stands in real or display name; else 0."""
    q, names = query.lower(), [F.lower(or_empty(n)) for n in (real, display, user)]
    equal = names[0].isin(q) | names[1].isin(q) | names[2].isin(q)
    inside = names[0].contains(q) | names[1].contains(q) | names[2].contains(q)
    letters = F.array(*[F.lit(c) for c in q if c.strip()]) if q.strip() else F.array().cast("array<string>")
    every = F.forall(letters, lambda c: names[0].contains(c) | names[1].contains(c))
    return F.when(equal, 3).when(inside, 2).when(every, 1).otherwise(0)


def keep_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def first_success(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the earliest part that has any for the key."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        both = p if both is None else both.unionByName(p)
    best = F.min("priority").over(Window.partitionBy(key))
    return both.withColumn("__best", best).where("priority = __best").drop("__best")


def head_per_group(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; the number is a literal, so Spark cuts groups before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def directory_matches(users: DataFrame, name: str, group: str, place: str, enough: int = 10, names=("name", "en_name"), ids=("user_id", "open_id")) -> DataFrame:
    """Users of which one name holds ``name``, in the order of their group and place, up to the end of the group
    in which ``enough`` were found; one row for each first known id, the earliest; a user without any id stays."""
    found = users.where(F.exists(F.array(*[or_empty(F.col(n)) for n in names]), lambda x: x.contains(name)))
    first = found.orderBy(group, place).limit(enough).agg(F.count(F.lit(1)).alias("__n"), F.max(group).alias("__last"))
    kept = found.join(F.broadcast(first), (F.col("__n") < enough) | (F.col(group) <= F.col("__last")))  # one row
    kept = kept.drop("__n", "__last").withColumn("__id", F.coalesce(*ids))
    unnamed = kept.where(F.col("__id").isNull())
    return keep_best(kept.where(F.col("__id").isNotNull()), ["__id"], F.col(group), F.col(place)).unionByName(unnamed).drop("__id")


def channel_cap(limit: int, n_channels: int, least: int = 100) -> int:
    """Messages to take from each channel; never fewer than ``least``, so the sum may pass the limit."""
    return max(least, limit // max(1, n_channels))


def direct_then_chats(messages: DataFrame, chats: DataFrame, target: str, chat: str, direct: Column, order: list[Column], limit: int, least: int = 100) -> DataFrame:
    """Each target's direct talk, at most ``limit`` rows; then, if any of the limit remains, of each of their chats at
    most max(least, remaining // number of chats), so the sum may pass the limit.

    chats: (target, chat), every chat that a target is in, also those without messages; a target without chats gets
    direct talk only. direct: whether a message is direct talk. Counts combine on the map side; groups are first cut to
    what any target may take, a literal, so Spark cuts them before the shuffle, and then to their own number.
    """
    own = head_per_group(messages.where(direct), [target], order, limit)
    used = messages.where(direct).groupBy(target).agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("__used"))
    count = chats.select(target, chat).distinct().groupBy(target).agg(F.count(F.lit(1)).alias("__chats"))
    left = F.lit(limit) - F.coalesce("__used", F.lit(0))
    caps = count.join(used, target, "left").where(left > 0).select(target, F.greatest(F.lit(least), F.floor(left / F.col("__chats"))).alias("__cap"))
    n = F.row_number().over(Window.partitionBy(target, chat).orderBy(*order))
    rest = messages.where(~direct).join(chats.select(target, chat).distinct(), [target, chat], "left_semi").withColumn("__n", n).where(F.col("__n") <= max(least, limit))
    rest = rest.join(caps, target).where(F.col("__n") <= F.col("__cap")).drop("__n", "__cap")
    return own.unionByName(rest)


def descend(edges: DataFrame, root, depth: int | None = None, most_children: int | None = None, order: str = "child") -> DataFrame:
    """(node, depth): the root and the nodes below it, at most ``depth`` edges down where that is given.

    edges: (parent, child). With ``most_children`` only a node's first children, by ``order``, are followed.
    One join a level; each level is written, so the plan stays short and a lost executor costs one level. A
    node is visited once, at its least depth, so cycles end.
    """
    spark = edges.sparkSession
    if most_children is not None:
        edges = head_per_group(edges, ["parent"], [F.col(order), F.col("child")], most_children)
    folder, level = scratch_folder(spark, "tree"), 0
    edges = edges.select("parent", "child").distinct()
    edges.write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    spark.createDataFrame([(root, 0)], f"node {edges.schema['child'].dataType.simpleString()}, depth int").write.parquet(f"{folder}/level=0")
    while depth is None or level < depth:
        seen = spark.read.parquet(*[f"{folder}/level={k}" for k in range(level + 1)])
        frontier = spark.read.parquet(f"{folder}/level={level}")
        below = edges.join(frontier, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node")).distinct()
        below = below.join(seen, "node", "left_anti").withColumn("depth", F.lit(level + 1))
        below.write.parquet(f"{folder}/level={level + 1}")
        if spark.read.parquet(f"{folder}/level={level + 1}").isEmpty():
            break
        level += 1
    return spark.read.parquet(*[f"{folder}/level={k}" for k in range(level + 1)])
