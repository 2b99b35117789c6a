"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, once for each curve with a projection and a shift of its own, and ordered by
their place on a Hilbert curve. Spark range-partitions each ordering. A query looks at a window of ranks around its own in
every ordering; the windows' findings merge and are ranked by the true measure. The window's half-width is not guessed:
for a bounded sample of queries the true neighbours are found against all rows, and the window is made as wide as the
wanted share of them needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepost.llm.frames import only
from tidepost.session import written


@dataclass(frozen=True)
class Curves:
    """``recall`` is asked for in ``sample`` queries (about so many, by a hash); ``chunk`` bounds the rows a task compares
    at a time."""

    count: int = 4
    dimensions: int = 8
    bits: int = 7
    recall: float = 0.97
    sample: int = 64
    chunk: int = 32768
    seed: int = 11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2 ** bits (rows of ``cells``).

    Each plane of bits is turned and mirrored according to the planes above it, then the planes' bits are read in Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    dimensions = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        below = plane - 1
        for i in range(dimensions):
            high = (x[i] & plane) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
        plane >>= 1
    for i in range(1, dimensions):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where((x[-1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dimensions):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(row, vec_id, v): vectors with finite components that are not all zero, of the length that most have."""
    v = only(vectors, vec_id=vec_id, v=vector).select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    length = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("v") == (length[0] if length else 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def ordered(vectors: DataFrame, how: Curves) -> DataFrame:
    """(curve, rank, row, vec_id, v): every vector in every ordering, ranks from 0 in each. Written once.

    Inner products become distances on a sphere: one component more brings every vector to the length of the longest.
    """
    top = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2))
            if not len(v):
                continue
            wide = np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]], axis=1) / math.sqrt(top)
            for curve in range(how.count):
                random = np.random.default_rng([how.seed, curve])
                axes = np.linalg.qr(random.normal(size=(wide.shape[1], min(how.dimensions, wide.shape[1]))))[0]
                # Components of unit vectors are about 1 / sqrt(length) in size; three times that fills the cube.
                spread = 3 / math.sqrt(wide.shape[1])
                unit = (wide @ axes / spread + 1) / 2 * 0.75 + random.uniform(0, 0.25, size=axes.shape[1])
                cells = np.clip((unit * 2**how.bits).astype(np.int64), 0, 2**how.bits - 1)
                arrays = [pa.array(np.full(len(v), curve), pa.int32()), pa.array(hilbert(cells, how.bits)), *batch.columns]
                yield pa.RecordBatch.from_arrays(arrays, ["curve", "place", "row", "vec_id", "v"])

    placed = vectors.select("row", "vec_id", "v").mapInArrow(run, "curve int, place long, row long, vec_id long, v array<double>")
    placed = placed.repartitionByRange("curve", "place", "row").sortWithinPartitions("curve", "place", "row")
    numbered = written(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "curves")
    parts = numbered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"))
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    ranked = numbered.join(parts.drop("rows"), ["curve", "part"])
    return written(ranked.select("curve", (F.col("n") - F.col("first") + F.col("offset")).alias("rank"), "row", "vec_id", "v"), "ranks")


#: Queries and rows are told apart by the number of their row; ids come along for ties and results.
FOUND = "query long, query_id long, row long, vec_id long, score double"


def best(
    queries: np.ndarray, own: np.ndarray, rows: np.ndarray, numbers: np.ndarray, ids: np.ndarray, k: int, allowed: tuple | None = None
) -> tuple[np.ndarray, ...]:
    """(query, row, score) of the ``k`` largest inner products of each query, ties to the smaller id, then number; a
    query's ``own`` row, by its number, is left out."""
    out = []
    step = max(1, (1 << 22) // max(1, len(rows)))
    for a in range(0, len(queries), step):
        score = queries[a : a + step] @ rows.T
        score[own[a : a + step, None] == numbers[None, :]] = -np.inf
        if allowed is not None:
            score[np.abs(allowed[0][a : a + step, None] - allowed[1][None, :]) > allowed[2]] = -np.inf
        if score.shape[1] > k:
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            q, r = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        else:
            q, r = np.nonzero(score > -np.inf)
        out.append((q + a, r, score[q, r]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    q, r, s = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((numbers[r], ids[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], r[keep], s[keep]


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: list[tuple[int, int, list[float]]], k: int) -> DataFrame:
    """The true neighbours of a few queries, in one pass over all rows."""
    own, ids = (np.array([q[i] for q in queries], np.int64) for i in (0, 1))
    wanted = np.array([q[2] for q in queries], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, row_ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            q, r, s = best(wanted, own, matrix(batch.column(2)), numbers, row_ids, k)
            arrays = [pa.array(x) for x in (own[q], ids[q], numbers[r], row_ids[r], s)]
            yield pa.RecordBatch.from_arrays(arrays, ["query", "query_id", "row", "vec_id", "score"])

    return top(vectors.select("row", "vec_id", "v").mapInArrow(run, FOUND), k)


def window(vectors: DataFrame, ranks: DataFrame, is_query: Column, k: int, how: Curves) -> int:
    """The half-width of the windows: so wide that ``how.recall`` of the sample's true neighbours are inside one."""
    queries = vectors.filter(is_query)
    some = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(how.seed)), F.lit(max(1, queries.count() // how.sample))) == 0)
    sample = [tuple(r) for r in some.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(2 * how.sample).collect()]
    if not sample:
        return 0
    true = written(exact(vectors, sample, k).select("query", "row"), "true")
    slim = ranks.select("curve", "rank", "row")
    mine = slim.select("curve", F.col("rank").alias("mine"), F.col("row").alias("query"))
    apart = true.join(slim, "row").join(mine, ["curve", "query"]).groupBy("query", "row").agg(F.min(F.abs(F.col("rank") - F.col("mine"))).alias("d"))
    return apart.agg(F.percentile("d", F.lit(how.recall))).first()[0] or 0


def search(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", how: Curves | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, by largest inner product in double
    precision, ties to the smaller id; a query's own row is no candidate. ``is_query`` is a condition on ``vec_id``.

    Rows with a null id, a null, zero, null-holding or non-finite vector, or one of another length than most, take no part.
    Every other row is indexed. Fewer than ``k`` candidates give fewer rows; an empty table gives none. Rows that share an
    id are rows of their own: each is searched for and found, by each other too.
    """
    how = how or Curves()
    good = written(usable(vectors, vec_id, vector), "vectors")
    ranks = ordered(good, how)
    half = int(math.ceil(window(good, ranks, is_query, k, how)))
    chunk = F.floor(F.col("rank") / how.chunk).cast("long")
    asked = ranks.filter(is_query).withColumn("near", chunk)
    spread = F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - half) / how.chunk)), F.floor((F.col("rank") + half) / how.chunk))
    # Queries of one stretch of the curve meet the chunks of rows that their windows touch.
    left = asked.select("curve", "near", F.explode(spread).alias("far"), "rank", "row", "vec_id", "v")
    met = left.select("curve", "near", "far").distinct()
    right = ranks.withColumn("far", chunk).join(met, ["curve", "far"])
    right = right.select(*[F.col(c).alias(f"row_{c}") for c in ("curve", "near", "far", "rank", "row", "vec_id", "v")])

    def compare(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if q.empty or rows.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (x.replace("long", "int64").replace("double", "float64").split() for x in FOUND.split(", "))})
        own, numbers, row_ids = q["row"].to_numpy(), rows["row_row"].to_numpy(), rows["row_vec_id"].to_numpy()
        near = (q["rank"].to_numpy(), rows["row_rank"].to_numpy(), half)
        a, b, s = best(np.stack(q["v"].to_numpy()), own, np.stack(rows["row_v"].to_numpy()), numbers, row_ids, k, near)
        return pd.DataFrame({"query": own[a], "query_id": q["vec_id"].to_numpy()[a], "row": numbers[b], "vec_id": row_ids[b], "score": s})

    keys = ["curve", "near", "far"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"row_{c}" for c in keys])).applyInPandas(compare, FOUND)
    # One row is found in several orderings.
    merged = found.groupBy("query", "query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    return top(merged, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
