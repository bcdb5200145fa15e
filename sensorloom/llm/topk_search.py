"""Exact top-k inner-product search by a Voronoi join.

Data vectors are grouped by their nearest pivot.  A group's summary (its size,
the range of its vectors along the pivot's direction, how far they are off it,
their largest norm and radius) bounds every query's scores with the group.  Each
query first goes to the one group that promises most, and the k-th score that
it finds there is a floor for its answer.  Then only groups whose bound reaches
the floor get the query.  Groups are dealt in blocks of bounded size, each block
is solved locally, and the blocks' answers are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

K = 10
#: Pivots are about as many as the square root of the rows, up to this; blocks take this many bytes of vectors.
MAX_PIVOTS = 2048
BLOCK_BYTES = 8 << 20
QUERY_ROWS = 256
#: Pivots next to a query whose bisectors with a group's pivot bound the group.
BISECTORS = 4
SCALE = 1024.0
#: Whole numbers up to this, and sums that stay below it, are exact in doubles.
EXACT = float(1 << 53)
_LEAST = np.iinfo(np.int64).min

DATA_SCHEMA = "vec_id long, vector binary, pivot int, part int, along double, off double, norm double, radius double"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), dim)


def quantised(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id and floor(1024 * x) of each component as a vector of doubles, which
    hold these whole numbers exactly; the dimension and the rows.  Shorter
    vectors count as if zeros followed, empty ones as zeros."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    dim, n = rows.agg(F.max(F.size("vector")), F.count("*")).first()
    dim = max(dim, 1) if n else 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            out, sizes = np.zeros((len(lists), dim)), np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            with np.errstate(over="ignore"):
                out[at] = np.nan_to_num(np.floor(flat * SCALE))  # beyond a double's range: its end
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in out], pa.binary())], ["vec_id", "vector"])

    return rows.mapInArrow(packed, "vec_id long, vector binary"), dim, n


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int | None = None, block_rows: int | None = None, compared=None) -> DataFrame:
    """Each query's ``k`` highest inner products with other rows.

    ``vectors`` needs vec_id and embedding; rows where ``is_query`` (a Column)
    holds are queries, all rows but those of the query's own vec_id are
    candidates.  Vectors null or holding null or non-finite components, and
    rows without vec_id, take no part; other columns, whatever their names, are
    not read; an empty table gives an empty result.  Returns query_id, rank
    (from 1), vec_id and score; ties go to the smaller vec_id; fewer rows where
    there are fewer candidates.  Repeated rows, and rows of one vec_id with
    different vectors, are candidates each; queries of one vec_id share one
    answer, the best of all their pairs.  Scores are exact whole numbers; one
    beyond a long's range becomes the end of that range.  ``compared``, an
    accumulator, adds up the pairs that are scored.
    """
    spark = vectors.sparkSession
    data, dim, n = quantised(vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding"))
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = pivots or max(1, min(MAX_PIVOTS, math.isqrt(n)))
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * dim))
    sample = data.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(pivots).collect()  # MAX_PIVOTS vectors at most
    centres = np.unique(np.array([np.frombuffer(r["vector"]) for r in sample]), axis=0)
    directions = centres / np.maximum(np.linalg.norm(centres / _size(centres), axis=1, keepdims=True) * _size(centres), 1e-300)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest pivot, a number that splits its group, and where it is: along the pivot's direction, off it, and from the pivot."""
        with np.errstate(over="ignore", invalid="ignore"):
            centre_norms = (centres**2).sum(1)
            for batch in batches:
                x = _matrix(batch.column("vector"), dim)
                near = (centre_norms - 2 * x @ centres.T).argmin(1)
                square = (x**2).sum(1)
                along = (x * directions[near]).sum(1)
                off = np.sqrt(np.maximum(square - along**2, 0))
                radius = np.sqrt(((x - centres[near]) ** 2).sum(1))
                # From the row alone, so that a task that is repeated deals its rows alike.
                part = [xxhash.xxh32_intdigest(v, int(i) & 0xFFFFFFFF) >> 1 for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True)]
                part = np.array(part, np.int32)
                found = [near.astype(np.int32), part, along, off, np.sqrt(square), radius]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], ["vec_id", "vector", "pivot", "part", "along", "off", "norm", "radius"])

    grouped = data.mapInArrow(assign, DATA_SCHEMA)
    most = [F.max(c).alias(c) for c in ("off", "norm", "radius")]
    groups = grouped.groupBy("pivot").agg(F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), *most).collect()  # a row for each pivot
    bounds = _Bounds(centres, directions, groups)
    blocks = {r["pivot"]: max(1, -(-r["n"] // block_rows)) for r in groups}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each block of the groups it needs, up to QUERY_ROWS queries together."""
        for batch in batches:
            x, ids = _matrix(batch.column("vector"), dim), batch.column("vec_id").to_numpy()
            floors = batch.column("floor").to_numpy() if "floor" in batch.schema.names else None
            for a in range(0, len(ids), QUERY_ROWS):
                q, i = x[a : a + QUERY_ROWS], ids[a : a + QUERY_ROWS]
                need = bounds.first(q)
                if floors is not None:
                    need = bounds.reaching(q, floors[a : a + QUERY_ROWS]) & ~need
                rows = [(p, b, i[need[:, p]].tobytes(), q[need[:, p]].tobytes()) for p, n in blocks.items() if need[:, p].any() for b in range(n)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["pivot", "block", "ids", "queries"])

    n_blocks = F.create_map(*[F.lit(int(x)) for pair in blocks.items() for x in pair])
    blocked = grouped.select("vec_id", "vector", "pivot", F.pmod("part", n_blocks[F.col("pivot")]).cast("int").alias("block"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(left.column("vector"), dim)[order]
            for raw_ids, raw in zip(right.column("ids").to_pylist(), right.column("queries").to_pylist(), strict=True):
                q_ids = np.frombuffer(raw_ids, np.int64)
                scores = _products(np.frombuffer(raw).reshape(len(q_ids), dim), x)
                scores[q_ids[:, None] == ids] = _LEAST
                if compared is not None:
                    compared.add(scores.size)
                for q, row in zip(q_ids, scores, strict=True):
                    best = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    best = best[np.argsort(~row[best], kind="stable")][:k]
                    best = best[row[best] > _LEAST]
                    parts.append((np.full(len(best), q), ids[best], row[best]))
        q, v, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    def answers(queries: DataFrame) -> DataFrame:
        dealt = queries.mapInArrow(deal, "pivot int, block int, ids binary, queries binary")
        keys = ["pivot", "block"]
        return blocked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")

    # Spark limits each task's rows of a query to k before they are shuffled, and again when they are merged.
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_k = lambda found: found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)

    queries = data.filter(is_query)
    probed = C.stored(best_k(answers(queries)), "probed")
    floors = probed.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    rest = answers(queries.join(floors, "vec_id", "left").select("vec_id", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
    return best_k(probed.drop("rank").unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _size(x: np.ndarray) -> np.ndarray:
    """The largest component of each row, 1 at least; dividing by it keeps squares in range."""
    return np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of whole-number rows, exactly, as longs; beyond a long's range its end."""
    dim = q.shape[1]
    top_q, top_x = np.abs(q).max(1, initial=0), np.abs(x).max(1, initial=0)
    limit = math.sqrt(EXACT / dim)
    small_q, small_x = top_q < limit, top_x < limit
    if small_q.all() and small_x.all():
        return (q @ x.T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    out[np.ix_(small_q, small_x)] = (q[small_q] @ x[small_x].T).astype(np.int64)
    whole = lambda m: [[int(v) for v in row] for row in m]
    all_q, all_x = whole(q), whole(x)
    for i, a in enumerate(all_q):
        for j in np.flatnonzero(~small_x | ~small_q[i]).tolist():
            out[i, j] = max(_LEAST + 1, min(-(_LEAST + 1), sum(u * v for u, v in zip(a, all_x[j], strict=True))))
    return out


class _Bounds:
    """What the groups' summaries say about queries' scores; as large as the pivots."""

    def __init__(self, centres: np.ndarray, directions: np.ndarray, groups: list):
        self.centres, self.directions = centres, directions
        self.low, self.high, self.off, self.norm, self.radius = (np.zeros(len(centres)) for _ in range(5))
        self.full = np.zeros(len(centres), bool)
        for r in groups:
            p = r["pivot"]
            self.full[p] = True
            self.low[p], self.high[p], self.off[p], self.norm[p], self.radius[p] = (r[c] for c in ("low", "high", "off", "norm", "radius"))

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """queries x pivots: no score of the query with a vector of the group is above this."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            norm = np.sqrt((queries**2).sum(1))
            at, along = queries @ self.centres.T, queries @ self.directions.T
            # Along the pivot's direction and off it, each by its range; around the pivot; and by norm.
            off = np.sqrt(np.maximum(norm[:, None] ** 2 - along**2, 0))
            bound = np.maximum(along * self.low, along * self.high) + off * self.off
            bound = np.fmin(bound, at + norm[:, None] * self.radius)
            bound = np.fmin(bound, norm[:, None] * self.norm)
            # Vectors of a group are on its pivot's side of each bisector: x . u <= half, with u from the pivot to the other.
            square = (self.centres**2).sum(1)
            distance = square[:, None] + square - 2 * self.centres @ self.centres.T
            for other in np.argsort(-at, axis=1)[:, :BISECTORS].T:
                apart = np.sqrt(np.maximum(distance[other], 0))
                toward = (at[np.arange(len(at)), other][:, None] - at) / apart
                half = (square[other][:, None] - square) / (2 * apart)
                rest = np.sqrt(np.maximum(norm[:, None] ** 2 - toward**2, 0))
                # The best point of a ball of the group's norm; if it is beyond the bisector, the best point on that.
                beyond = (self.norm * toward > half * norm[:, None]) & (apart > 1e-6 * (1 + np.sqrt(square)))
                on = toward * half + rest * np.sqrt(np.maximum(self.norm**2 - half**2, 0))
                bound = np.where(beyond, np.fmin(bound, on), bound)
            slack = 1e-6 + 1e-9 * norm[:, None] * (self.norm + self.radius)
            return np.where(np.isfinite(bound), bound + slack, np.inf)

    def first(self, queries: np.ndarray) -> np.ndarray:
        """queries x pivots: the one group that promises most."""
        with np.errstate(over="ignore", invalid="ignore"):
            promise = np.where(self.full, np.nan_to_num(queries @ self.centres.T), -np.inf)
        return np.arange(len(self.full)) == promise.argmax(1)[:, None]

    def reaching(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """queries x pivots: whether the group can hold a score of at least the query's floor."""
        return (self.upper(queries) >= floors[:, None]) & self.full


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
