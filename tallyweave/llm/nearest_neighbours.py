"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of `TABLES` tables hashes a vector by `FUNCTIONS` projections on Gaussian directions, cut into steps of a fitted
width. A query visits a table's buckets in the order of their estimated chance to hold a neighbour at the fitted distance
(a neighbour's projection is the query's plus Gaussian noise of that size), best first, until the chances add up to
`SUCCESS`. The candidates of all tables are merged and ranked by exact Euclidean distance in double precision.

Only the step width is fitted, on at most about `SAMPLE` vectors drawn by a hash: it is the distance within which the
sample's own k-th neighbours lie, so at least that of the whole table. Every vector is indexed. Buckets are dealt out in
chunks, so a bucket that holds a third of all vectors is spread over many tasks; nothing in it is skipped. A query that meets fewer
than k vectors is held against all vectors of its length.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of another length are no
candidates. Ties go to the smaller vec_id. Every row but the query's own is a candidate: rows that repeat a vec_id, with the
same vector or another one, are queries and candidates of their own, so a query_id may have several lists, and a query's
twin may be its neighbour at distance 0. Without candidates a query has no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import small_batches, stored, table, unit_hash

TABLES = 3
FUNCTIONS = 4
SUCCESS = 0.65
SAMPLE = 4000
#: Vectors, or queries, of one bucket in one group.
CHUNK = 768


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


@dataclass(frozen=True)
class Hashing:
    """reach: the distance at which neighbours are expected, for each vector length; steps are as wide."""

    reach: dict[int, float]
    tables: int
    functions: int
    success: float
    seed: int

    def places(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """The vectors' projections in table t, in steps."""
        n = vectors.shape[1]
        r = np.random.RandomState((self.seed * 1_000_003 + t * 7919 + n) % 2**32)
        width = self.reach.get(n, 1.0)
        return (vectors @ r.standard_normal((n, self.functions)) + r.random_sample(self.functions) * width) / width

    @staticmethod
    def bucket(cells: np.ndarray, n: int, t: int) -> np.ndarray:
        h = np.full(len(cells), n * 64 + t + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(cells.shape[1]):
            h = (h ^ cells[:, i].astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def probes(self, place: np.ndarray) -> np.ndarray:
        """Cells around a query's place in estimated success order, until the chances reach `success`."""
        sides = []
        for f in place:
            cells = np.arange(math.floor(f - 4), math.floor(f + 4) + 1)
            chance = [0.5 * (math.erf((c + 1 - f) / math.sqrt(2)) - math.erf((c - f) / math.sqrt(2))) for c in cells]
            sides.append(sorted(zip(chance, cells.tolist()), reverse=True))
        m = len(sides)
        start = (0,) * m
        heap, seen, total, out = [(-math.prod(s[0][0] for s in sides), start)], {start}, 0.0, []
        while heap and total < self.success:
            chance, at = heapq.heappop(heap)
            total -= chance
            out.append([sides[i][a][1] for i, a in enumerate(at)])
            for i in range(m):
                if at[i] + 1 < len(sides[i]):
                    then = (*at[:i], at[i] + 1, *at[i + 1 :])
                    if then not in seen:
                        seen.add(then)
                        heapq.heappush(heap, (chance / sides[i][at[i]][0] * sides[i][at[i] + 1][0], then))
        return np.array(out, np.int64)


def _matrix(lists: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: their places in the batch and their matrix."""
    sizes = np.array([len(v) for v in lists])
    return {int(n): (np.flatnonzero(sizes == n), np.array([v for v in lists if len(v) == n], np.float64)) for n in np.unique(sizes)}


def fit(vectors: DataFrame, k: int, tables: int = TABLES, functions: int = FUNCTIONS, success: float = SUCCESS, sample: int = SAMPLE, seed: int = 0) -> Hashing:
    """vectors(id, v): only usable ones."""
    total = vectors.count()
    drawn = vectors.where(unit_hash(F.lit("vector sample"), "id") < min(1.0, sample / max(1, total))).select("v").collect()  # bounded sample
    reach = {}
    for n, (_, x) in _matrix([r.v for r in drawn]).items():
        some = x[:500]
        d = np.sort(np.maximum(0, (some**2).sum(1)[:, None] + (x**2).sum(1) - 2 * some @ x.T), axis=1)
        own = np.sqrt(d[:, min(k, d.shape[1] - 1)])
        own = own[own > 1e-9]  # copies are in one bucket anyway
        reach[n] = float(np.quantile(own, 0.9)) if len(own) else max(1e-6, float(np.abs(x).max()))
    return Hashing(reach, tables, functions, success, seed)


def search(vectors: DataFrame, asks: Column, k: int = 10, hashing: Hashing | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest vectors found of each row that asks (a condition on vectors), but itself."""
    small_batches(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # stored: a row keeps its number
    own, asked = numbered.drop("asks"), numbered.where("asks").drop("asks")
    kind = own.schema["id"].dataType.simpleString()
    hashing = hashing or fit(own, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, (at, x) in _matrix(b.column(1).to_pylist()).items():
                pick = pa.array(at)
                for t in range(hashing.tables):
                    buckets = hashing.bucket(np.floor(hashing.places(x, t)), n, t)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets), *(c.take(pick) for c in b.columns)], names=["bucket", "id", "v", "row"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, (at, x) in _matrix(b.column(1).to_pylist()).items():
                for t in range(hashing.tables):
                    for i, place in zip(at.tolist(), hashing.places(x, t)):
                        buckets = hashing.bucket(hashing.probes(place), n, t)
                        pick = pa.array(np.full(len(buckets), i))
                        yield pa.RecordBatch.from_arrays([pa.array(buckets), *(c.take(pick) for c in b.columns)], names=["bucket", "id", "v", "row"])

    shape = f"bucket long, id {kind}, v array<double>, row long"
    filed = stored(own.mapInArrow(index, shape), "vectors-by-bucket")
    probed = stored(asked.mapInArrow(probe, shape), "probes")
    found = _nearest_by_bucket(filed, probed, k)
    key = ("query_id", "query_row", "id", "row")
    merged = stored(found.groupBy(*key).agg(F.min("distance").alias("distance")), "candidates")
    # Queries that met fewer than k vectors are held against all vectors of their length, in blocks.
    enough = merged.groupBy("query_id", "query_row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = stored(asked.join(enough.hint("merge"), (F.col("id") == F.col("query_id")) & (F.col("row") == F.col("query_row")), "left_anti"), "short-queries")
    if not short.isEmpty():
        by_length = lambda rows: rows.select(F.size("v").cast("long").alias("bucket"), "id", "v", "row")
        rest = _nearest_by_bucket(by_length(own), by_length(short), k).groupBy(*key).agg(F.min("distance").alias("distance"))
        gone = short.select(F.col("id").alias("query_id"), F.col("row").alias("query_row")).distinct()
        merged = merged.join(gone.hint("merge"), ["query_id", "query_row"], "left_anti").unionByName(rest)
    order = Window.partitionBy("query_id", "query_row").orderBy("distance", "id", "row")  # a query's rows: k for each bucket it visits
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _nearest_by_bucket(filed: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """(query_id, query_row, id, row, distance): the k nearest vectors of every chunk of every bucket that a query visits."""
    kind = filed.schema["id"].dataType.simpleString()
    sizes = filed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    asks = probed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("askers"))
    both = stored(sizes.join(asks.hint("merge"), "bucket"), "bucket-sizes")  # only buckets that are visited

    def dealt(rows: DataFrame, mine: str, other: str, me: str, them: str) -> DataFrame:
        rows = rows.join(both.hint("merge"), "bucket").withColumn(me, F.pmod(F.xxhash64("row"), F.col(mine)))
        return rows.withColumn(them, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("bucket", "part", "asker", "id", "v", "row")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": [], "query_row": [], "id": [], "row": [], "distance": []})
        if left.empty or right.empty:
            return nothing
        x, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        ids, rows, askers, asking = left["id"].to_numpy(), left["row"].to_numpy(), right["id"].to_numpy(), right["row"].to_numpy()
        norms, out = (x**2).sum(1), []
        for a in range(0, len(q), 256):
            part, who, which = q[a : a + 256], askers[a : a + 256], asking[a : a + 256]
            rough = (part**2).sum(1)[:, None] + norms - 2 * part @ x.T
            rough[which[:, None] == rows[None, :]] = np.inf
            for i, row in enumerate(rough):
                if len(row) > k:  # all that may be among the k nearest, rounding of the rough distance allowed for
                    bound = np.partition(row, k - 1)[k - 1]
                    at = np.flatnonzero(row <= bound + 1e-9 * (1 + abs(bound) + norms.max()))
                else:
                    at = np.arange(len(row))
                at = at[np.isfinite(row[at])]
                d = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
                best = np.lexsort((ids[at], d))[:k]
                out.append(pd.DataFrame({"query_id": who[i], "query_row": which[i], "id": ids[at][best], "row": rows[at][best], "distance": d[best]}))
        return pd.concat(out) if out else nothing

    key = ("bucket", "part", "asker")
    candidates = dealt(filed, "parts", "askers", "part", "asker")
    askers = dealt(probed, "askers", "parts", "asker", "part")
    return candidates.groupBy(*key).cogroup(askers.groupBy(*key)).applyInPandas(nearest, f"query_id {kind}, query_row long, id {kind}, row long, distance double")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = search(vectors, F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))
