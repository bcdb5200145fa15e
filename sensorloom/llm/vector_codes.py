"""Product codes for vectors: each part of a vector becomes the number of its
nearest codebook entry.

Vectors are packed once into blocks of columns, a column for each component.  A
round is one treeAggregate over the blocks: squared distances to all entries
build up component by component, ``np.add.at`` adds a block's parts into sums
and counts by entry, and these tensors, a few dozen kB at any size of the table,
merge through a tree of reducers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
#: Vectors of a block that are compared at once: so many by ENTRIES distances are held.
STEP = 4096
#: Reducers of a level of the tree for one of the next.
TREE_FAN_IN = 16
_LONG = np.iinfo(np.int64)

BLOCK_SCHEMA = "n int, vec_id binary, label binary, nulls binary, columns binary"
CODE_SCHEMA = "vec_id long, code string, error long, of_label int"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the components as doubles of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def _floors(x: np.ndarray, exact: bool) -> np.ndarray:
    """floor(SCALE * x) as whole numbers: int64, or Python's own where products would not fit."""
    if exact:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [int(SCALE) * int(v) if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def _pack(dim: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each batch: its vectors as columns; shorter vectors go on with zeros."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("vector")
            x, sizes = np.zeros((n, dim)), np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            x[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            ids, labels = batch.column("vec_id"), batch.column("label")
            nulls = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in (ids, labels)]).astype(np.uint8)
            plain = [np.ascontiguousarray(c.fill_null(0).to_numpy(zero_copy_only=False), t).tobytes() for c, t in ((ids, np.int64), (labels, np.int32))]
            row = [n, *plain, nulls.tobytes(), np.ascontiguousarray(x.T).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.binary()] * 4], strict=True)], ["n", "vec_id", "label", "nulls", "columns"])

    return packed


def _columns(packed: bytes, n: int, exact: bool) -> np.ndarray:
    """PARTS x components of a part x vectors of a block."""
    x = np.frombuffer(packed)
    return _floors(x.reshape(PARTS, len(x) // (PARTS * n), n), exact)


def assigned(columns: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PARTS x vectors: the nearest entry of each part, the first of equally near ones, and its squared distance."""
    parts, width, n = columns.shape
    nearest = np.zeros((parts, n), np.int64)
    distance = np.zeros((parts, n), columns.dtype)
    for p in range(parts):
        for a in range(0, n, STEP):
            total = np.zeros((min(STEP, n - a), codebooks.shape[1]), columns.dtype)
            for d in range(width):
                off = columns[p, d, a : a + STEP, None] - codebooks[p, :, d]
                total += off * off
            nearest[p, a : a + STEP] = best = total.argmin(1)
            distance[p, a : a + STEP] = total[np.arange(len(total)), best]
    return nearest, distance


def _added(acc: tuple | None, columns: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x entries x components) and counts by entry, with a block's parts added."""
    parts, width, n = columns.shape
    sums, counts = acc or (np.zeros(codebooks.shape, codebooks.dtype), np.zeros(codebooks.shape[:2], np.int64))
    nearest, _ = assigned(columns, codebooks)
    for p in range(parts):
        np.add.at(counts[p], nearest[p], 1)
        for d in range(width):
            np.add.at(sums[p, :, d], nearest[p], columns[p, d])
    return sums, counts


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    return a or b if a is None or b is None else (a[0] + b[0], a[1] + b[1])


def moved(codebooks: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry at the floor of its parts' mean; an unused one where it was."""
    used = counts > 0
    means = sums // np.maximum(counts, 1)[:, :, None]
    return np.where(used[:, :, None], means, codebooks)


def codebook_digest(codebooks: np.ndarray) -> str:
    return sha256(",".join(str(int(x)) for x in codebooks.ravel()).encode()).hexdigest()


def _coded(codebooks: np.ndarray, exact: bool):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                nearest, distance = assigned(_columns(row["columns"], n, exact), codebooks)
                # An object column's sum is exact; a long holds it up to its end.
                errors = distance.sum(0) if exact else np.array([min(int(x), _LONG.max) for x in distance.sum(0)], np.int64)
                hexed = np.ascontiguousarray(nearest.T.astype(np.uint8)).tobytes().hex()
                codes = [hexed[i : i + 2 * PARTS] for i in range(0, len(hexed), 2 * PARTS)]
                no_id, no_label = np.frombuffer(row["nulls"], np.uint8).reshape(2, n).astype(bool)
                ids, labels = (pa.array(np.frombuffer(row[c], t), mask=m) for c, t, m in (("vec_id", np.int64, no_id), ("label", np.int32, no_label)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(codes, pa.string()), pa.array(errors.astype(np.int64)), labels], ["vec_id", "code", "error", "of_label"])

    return coded


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Each vector's code, its error, the error of all vectors of its label, and a digest of the codebooks.

    ``vectors`` needs vec_id, embedding and label; other columns aren't read.
    Components are taken as floor(256 * x); a vector is cut into 16 equal parts,
    each with a codebook of up to 256 ``entries``, which begins as the parts of
    the vectors of least vec_id and moves to the floor of its parts' means in each
    of ``rounds``.  Ties go to the first entry; an unused entry stays.  Vectors
    null or holding null or non-finite components take no part.  Rows without
    vec_id are coded as well and come last as entries; rows of one vec_id are
    ordered by vector, then label.  With fewer rows than ``entries`` each row is
    one, equal rows too.  Shorter vectors, and all vectors up to the next
    multiple of 16 components, go on with zeros; empty arrays are vectors of
    zeros.  Null labels are one label.  Whole numbers are exact at any size of
    components; an error past a long's range is its end.  An empty table gives an
    empty result.
    """
    rows = usable(vectors)
    most = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    n, longest, reach = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(most)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = -(-longest // PARTS) * PARTS
    most = SCALE * min(reach, 1e300) + 1
    exact = most * n < 2.0**62 and 4 * most * most * max(1, dim) < 2.0**62
    starts = rows.orderBy(F.asc_nulls_last("vec_id"), "vector", F.asc_nulls_first("label")).limit(entries).collect()  # 256 vectors at most
    first = np.array([[*r["vector"], *[0.0] * (dim - len(r["vector"]))] for r in starts], np.float64)
    codebooks = np.ascontiguousarray(_floors(first, exact).reshape(len(starts), PARTS, dim // PARTS).transpose(1, 0, 2))
    blocks = C.stored(rows.mapInArrow(_pack(dim), BLOCK_SCHEMA), "vector-blocks")
    for _ in range(rounds):
        codebooks = _round(blocks, codebooks, exact)
    errors = blocks.select("n", "vec_id", "label", "nulls", "columns").mapInArrow(_coded(codebooks, exact), CODE_SCHEMA)
    errors = C.stored(errors, "vector-codes")
    by_label = errors.groupBy("of_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = by_label.select(F.col("of_label").alias("label"), F.least("total", F.lit(int(_LONG.max)).cast("decimal(38,0)")).cast("long").alias("label_error"))
    found = errors.join(by_label, errors["of_label"].eqNullSafe(by_label["label"]))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def _round(blocks: DataFrame, codebooks: np.ndarray, exact: bool) -> np.ndarray:
    """Codebooks after one round over all blocks."""
    held = blocks.rdd.map(lambda r: (r["n"], r["columns"]))
    add = lambda acc, b: _added(acc, _columns(b[1], b[0], exact), codebooks)
    levels = max(2, math.ceil(math.log(max(2, held.getNumPartitions()), TREE_FAN_IN)))
    sums, counts = held.treeAggregate(None, add, _merged, depth=levels)
    return moved(codebooks, sums, counts)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in SQL: parts as rows, each assignment a join of parts with their codebook."""
    assign = "SELECT v.i, v.part, v.q, arg_min(c.entry, (d.s, c.entry)) AS entry, min(d.s) AS s FROM parts v JOIN {c} c ON c.part = v.part, LATERAL (SELECT list_sum(list_transform(range(1, len(v.q) + 1), lambda k: (v.q[k] - c.q[k]) * (v.q[k] - c.q[k]))) AS s) d GROUP BY v.i, v.part, v.q"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(c=f'c{r}')})")
        steps.append(f"""m{r} AS (SELECT part, entry, list(m ORDER BY k) AS q FROM (SELECT part, entry, k, CAST(floor(sum(q[k])::DOUBLE / count(*)) AS BIGINT) AS m
            FROM a{r}, LATERAL (SELECT unnest(range(1, len(q) + 1)) AS k) GROUP BY part, entry, k) GROUP BY part, entry)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (part, entry))")
    last = f"c{ROUNDS}"
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER (ORDER BY vec_id) - 1 AS i
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT i, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS q FROM kept, (SELECT unnest(range(0, 16)) AS part)
), c0 AS MATERIALIZED (SELECT part, i AS entry, q FROM parts WHERE i < 64),
{", ".join(steps)},
f AS MATERIALIZED ({assign.format(c=last)}),
coded AS (SELECT i, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(s) AS BIGINT) AS error FROM f GROUP BY i),
book AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (i), book
"""


ORACLE_SQL = _sql()
