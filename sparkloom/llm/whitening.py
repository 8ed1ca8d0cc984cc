"""Embedding whitening: Welford's updates per partition, merged pairwise, and a symmetric QR eigen-solve.

Each partition runs through its vectors once and keeps their number, exact sums, running means and the sums of
centred products, updated by rank one for each vector. States of partitions are merged by the parallel update
formula, ``FAN`` at a time within Spark's tasks, so the driver receives one state of d x d numbers, whatever the
table's size. A symmetric matrix is solved by Householder tridiagonalisation and implicitly shifted QR steps.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import cut

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
#: States that a task merges at once.
FAN = 4
#: Scaled entries beyond this are taken as this, so that sums of a batch stay exact.
LARGEST = 2.0**40


class Moments(NamedTuple):
    """Of n vectors: exact sums, the mean relative to origin, and the sums of centred products."""

    n: int
    sums: list[int]
    origin: np.ndarray
    mean: np.ndarray
    products: np.ndarray


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of both lists together."""
    if not a.n or not b.n:
        return a if a.n else b
    n = a.n + b.n
    apart = (b.origin - a.origin).astype(np.float64) + (b.mean - a.mean)
    products = a.products + b.products + np.outer(apart, apart) * (a.n * (b.n / n))
    return Moments(n, [x + y for x, y in zip(a.sums, b.sums)], a.origin, a.mean + apart * (b.n / n), products)


def welford(blocks: Iterator[np.ndarray], width: int) -> Moments:
    """Moments of the blocks' rows, one rank-one update a row. The first row is the origin, so means stay small."""
    n, sums, origin = 0, [0] * width, None
    mean, products = np.zeros(width), np.zeros((width, width))
    for block in blocks:
        if not len(block):
            continue
        origin = block[0].copy() if origin is None else origin
        if block.dtype == np.int64:
            sums = [s + int(x) for s, x in zip(sums, block.sum(axis=0))]
        for row in (block - origin).astype(np.float64):
            n += 1
            before = row - mean
            mean += before / n
            products += before[:, None] * (row - mean)
    return Moments(n, sums, np.zeros(width) if origin is None else origin, mean, products)


def moments(rows: DataFrame, width: int, blocks_of: Callable[[pd.DataFrame], np.ndarray]) -> Moments:
    """Moments of all rows; blocks_of makes a batch's matrix. No rows give a state with n = 0."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = welford(map(blocks_of, batches), width)
        if state.n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        state = None
        for raw in group.sort_values("part")["state"]:
            nxt = pickle.loads(raw)
            state = nxt if state is None else merged(state, nxt)
        return pd.DataFrame({"part": [int(group["part"].min()) // FAN], "state": [pickle.dumps(state)]})

    schema = "part long, state binary"
    states = cut(rows.mapInPandas(one, schema))
    last = states.agg(F.max("part")).first()[0]
    if last is None:
        return welford(iter(()), width)
    for _ in range(math.ceil(math.log(last + 1, FAN) - 1e-9) if last else 0):
        states = states.groupBy(F.floor(F.col("part") / FAN).alias("__group")).applyInPandas(fold, schema)
    found = [pickle.loads(r.state) for r in states.collect()]  # one row, or FAN at most
    state = found[0]
    for nxt in found[1:]:
        state = merged(state, nxt)
    return state


# Eigenvectors ---------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, q) with q.T @ matrix @ q tridiagonal, by Householder reflections."""
    a, n = np.array(matrix, dtype=np.float64), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0.0:
            continue
        x[0] += math.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        below = a[k + 1:, k + 1:]
        p = 2.0 * (below @ v)
        p -= (v @ p) * v
        below -= np.outer(v, p) + np.outer(p, v)
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, x[0])
        q[:, k + 1:] -= np.outer(q[:, k + 1:] @ v, 2.0 * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns, the largest entry of each positive) of a symmetric matrix.

    Implicit QR steps with Wilkinson's shift, from the bottom up; a subdiagonal entry counts as zero once it is
    below the rounding of its neighbours.
    """
    d, e, q = tridiagonal(matrix)
    vectors, eps = np.ascontiguousarray(q.T), np.finfo(np.float64).eps  # rows are vectors, so a rotation is on two rows
    hi, steps = len(d) - 1, 0
    while hi > 0:
        small = np.flatnonzero(np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1:hi + 1])))
        lo = int(small[-1]) + 1 if len(small) else 0
        if lo == hi:
            e[hi - 1], hi, steps = 0.0, hi - 1, 0
            continue
        steps += 1
        if steps > 200:
            raise ArithmeticError("the eigenvalues don't settle")
        half = (d[hi - 1] - d[hi]) / 2.0
        edge = e[hi - 1]
        shift = d[hi] - edge * edge / (half + math.copysign(math.hypot(half, edge), half if half else 1.0))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (1.0, 0.0) if r == 0.0 else (x / r, z / r)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2.0 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2.0 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = vectors[k].copy()
            vectors[k] = c * upper + s * vectors[k + 1]
            vectors[k + 1] = c * vectors[k + 1] - s * upper
    order = np.argsort(-d, kind="stable")
    vectors = vectors[order]
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return d[order], (vectors * np.where(largest < 0, -1.0, 1.0)[:, None]).T


# Whitening ------------------------------------------------------------------------------------------


def _integers(vectors: pd.Series, width: int) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, width), np.int64)
    scaled = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * SCALE)
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - sums)^2; None beyond a long."""
    most = n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) // max(n, 1) + 1)
    if most < 2**62 and x.shape[1] * most * most < 2**62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    each = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x)
    return [v if v < 2**63 else None for v in each]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, of which whole numbers are taken away exactly first."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row a vector and component.

    Vectors that are null or empty, or hold null or non-finite entries, are left out; so are those of another
    length than the commonest (of equally common lengths the longest). Equal vectors and repeated or null keys
    count each on its own; other columns are not looked at. With fewer dimensions than ``components`` there is a
    component for each dimension. A component along which the vectors don't vary, beyond rounding, has a null
    whitened and isn't in identity_error, which is null if there is no other; explained is null where all vectors
    are equal. Components of equal eigenvalue are any that span their space. Scaled entries beyond 2^40 are taken
    as that; a deviation beyond a long is null. No vectors, no rows.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    sound = rows.select(F.col(key).alias("key"), v.cast("array<double>").alias("vector")).where(v.isNotNull() & (F.size(v) > 0) & finite)
    lengths = sound.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    kind = rows.schema[key].dataType
    out = StructType([StructField("key", kind), StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    width = lengths.width if lengths else 1
    sound = sound.where(F.size("vector") == width)
    state = moments(sound.select("vector"), width, lambda b: _integers(b["vector"], width))
    n, sums = state.n, state.sums
    values, vectors = symmetric_qr(state.products / max(n, 1))
    trace, k = float(np.trace(state.products)) / max(n, 1), min(components, width)
    real = values[:k] > max(float(values[0]), 0.0) * width * np.finfo(np.float64).eps
    to_unit = vectors[:, :k][:, real] / np.sqrt(values[:k][real])
    m = int(real.sum())

    def projected(b: pd.DataFrame) -> np.ndarray:
        return _centred(_integers(b["vector"], width), n, sums) @ to_unit

    error = None
    if m:
        again = moments(sound.select("vector"), m, projected)
        error = float(np.abs(again.products / again.n - np.eye(m)).max())

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _integers(b["vector"], width)
            values_of = np.full((len(x), k), np.nan)
            values_of[:, real] = _centred(x, n, sums) @ to_unit if len(x) else 0.0
            yield pd.DataFrame({"key": b["key"], "deviation": pd.Series(_deviations(x, n, sums), dtype=object), "whitened": list(values_of)})

    each = sound.mapInPandas(rows_of, out).select("key", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in values[:k]])
    return each.select(
        F.col("key").alias(key), (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"), F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
