"""A Merkle manifest of a dataset, and the proof of every row.

Leaves are digests of rows, built as columns and numbered within their source by
one range sort.  The tree itself is a Pregel-like exchange over RDDs: children
message their parents, a parent that has all its children hashes them and
messages its own, others wait.  Then paths go the other way: a parent sends each
child the siblings on the way to the root.  A row's path is only spelt out in
the run of up to 16 leaves that it belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Nodes that have one parent.
FAN_IN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree over the sources' roots.
TOP = -1
#: Rows of leaves in a partition.
LEAF_ROWS = 50_000

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: A node: its tree, how many leaves that tree has, its level (leaves have 0), and its place in the level.
Key = tuple[int, int, int, int]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree with ``n`` leaves."""
    return -(-n // FAN_IN**level)


def depth(n: int) -> int:
    """Levels above the leaves."""
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def parent(key: Key, sources: int) -> tuple[Key, int] | None:
    """A node's parent and its place among the parent's children; None for the root of all."""
    tree, n, level, at = key
    if width(n, level) > 1:
        return (tree, n, level + 1, at // FAN_IN), at % FAN_IN
    if tree == TOP or sources == 1:
        return None
    return (TOP, sources, 1, tree // FAN_IN), tree % FAN_IN


def n_children(key: Key) -> int:
    _, n, level, at = key
    return min(FAN_IN, width(n, level - 1) - FAN_IN * at)


# ------------------------------------------------------------------- leaves
def row_digest(**replaced: Column) -> Column:
    """The digest of a row's fields, each `-` if null, else its length in bytes, a colon and its value."""
    parts = []
    for name in FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, leaf and tampered (null where the row isn't tampered with) of each
    row, with its tree (its source's number), the tree's number of leaves, and
    its place among them.

    One range sort by source, doc_id and leaf deals a large source over many
    partitions; places follow from the rows that each partition has of a source.
    """
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, row_digest(text=F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), row_digest().alias("leaf"), tampered.alias("tampered"))
    rows = C.stored(rows.withColumn("copy", F.monotonically_increasing_id()), "merkle-rows")  # copy deals equal rows over partitions
    order = [F.asc_nulls_first(c) for c in ("source", "doc_id", "leaf", "copy")]
    parts = max(1, -(-rows.count() // LEAF_ROWS))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.select("doc_id", "source", "leaf", "tampered", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    placed = C.stored(placed, "merkle-leaves")
    shares = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("source").orderBy("part")  # a row for each partition that has the source
    shares = shares.select("source", "part", F.col("first") - F.sum("n").over(before) + F.col("n"), F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shares = shares.toDF("source", "part", "shift", "size")
    trees = _numbered(shares.select("source").distinct())
    shares = shares.join(trees, shares["source"].eqNullSafe(trees["of"])).select(F.col("source").alias("of"), F.col("part").alias("of_part"), "shift", "size", "tree")
    joined = placed.join(shares, (placed["part"] == shares["of_part"]) & placed["source"].eqNullSafe(shares["of"]))
    return joined.select("doc_id", "leaf", "tampered", "tree", "size", (F.col("row") - F.col("shift")).alias("at"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Each source (of) and its number (tree) in order, null first: partitions of a range sort, each counting on from those before it."""
    ordered = sources.orderBy(F.asc_nulls_first("source"))
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    return sources.sparkSession.createDataFrame(ranked, "of string, tree long", verifySchema=False)


# --------------------------------------------------------------- supersteps
class _Run:
    """Up to 16 consecutive leaves of a source, by place, and what their parent is."""

    def __init__(self, rows: list[tuple]):
        self.rows = sorted(rows)

    def digest(self, key: Key) -> str:
        return self.rows[0][2] if key[1] == 1 else digest(*[r[2] for r in self.rows])

    def proofs(self, key: Key, root: str | None, subroot: str | None, path: tuple[tuple[str, str], ...]) -> Iterator[tuple]:
        """A result row for each leaf. A lone leaf is its source's root and has no siblings of its own."""
        own = self.digest(key)
        root, subroot = root or own, subroot or own
        folded: dict[str, str] = {}
        for i, (_, doc_id, leaf, tampered) in enumerate(self.rows):
            left, right = "".join(r[2] for r in self.rows[:i]), "".join(r[2] for r in self.rows[i + 1 :])
            start = tampered or leaf
            if key[1] > 1:
                start = digest(left, start, right)
            if start not in folded:
                now = start
                for before, after in path:
                    now = digest(before, now, after)
                folded[start] = now
            proof = digest(left, right, *[x for pair in path for x in pair])
            yield doc_id, leaf, subroot, root, proof, folded[start], folded[start] == root


def _message_up(key: Key, own: str, sources: int) -> list[tuple[Key, tuple]]:
    above = parent(key, sources)
    return [(above[0], (above[1], own, key))] if above else []


def _go_up(key: Key, told: list[tuple], sources: int) -> list[tuple[Key, tuple]]:
    """A node that has been told of all its children tells its parent; until then what it was told waits."""
    if len(told) < n_children(key):
        return [(key, c) for c in told]
    return _message_up(key, digest(*[c[1] for c in told]), sources)


def manifest(docs: DataFrame) -> DataFrame:
    """Each row's leaf, its source's root (subroot), the root of all, the digest
    of its siblings on the way to the root (proof_sha256), and whether the row,
    as it is found on a second reading, still leads to the root.

    The second reading is a stand-in for a damaged copy: where 5 divides the
    row's crc32, text's A-Z are in lower case.  ``docs`` needs doc_id, source,
    lang, n_chars and text; other columns are not read.  Nulls in any column
    count as `-`; rows without doc_id come first in their source and are not
    tampered with.  Rows of one doc_id are ordered by their leaves, and equal
    rows are leaves each, with equal leaves and different proofs.  Empty texts
    are `0:`, a text without A-Z stays verified, long texts take one task's
    memory three times.  A lone leaf is its source's root, the root of a lone
    source the root; with nothing beside it its proof is the digest of nothing.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = leaves(docs)
    sizes = rows.agg(F.max("tree"), F.max("size"), F.count("*")).first()
    if sizes[0] is None:
        return spark.createDataFrame([], RESULT)
    sources, largest, n = sizes[0] + 1, sizes[1], sizes[2]
    parts = max(1, min(-(-n // LEAF_ROWS) * 2, 4096))
    own = rows.select("tree", "size", "at", "doc_id", "leaf", "tampered").rdd
    grouped = own.map(lambda r: ((r[0], r[1], 1, r[2] // FAN_IN), (r[2], r[3], r[4], r[5]))).groupByKey(_partitions(spark, parts))
    runs = grouped.mapValues(lambda x: _Run(list(x)))

    # Up: as many supersteps as levels above the runs; their shuffles are one job's, and a lost one is made again from the one before.
    waiting = runs.flatMap(lambda x: _message_up(x[0], x[1].digest(x[0]), sources))
    done: list[RDD] = []
    for _ in range(max(0, depth(largest) - 1) + depth(sources)):
        parts = max(1, parts // FAN_IN)
        told = waiting.groupByKey(_partitions(spark, parts)).mapValues(sorted)
        done.append(told.filter(lambda x: len(x[1]) == n_children(x[0])))
        waiting = told.flatMap(lambda x: _go_up(x[0], x[1], sources))

    # Down: a path waits until its node's turn; the node hands it on with one more level.
    top = (TOP, sources, depth(sources), 0) if sources > 1 else (0, largest, max(1, depth(largest)), 0)
    paths = spark.sparkContext.parallelize([(top, (None, None, ()))], 1)
    for level in reversed(done):
        paths = level.cogroup(paths, level.getNumPartitions()).flatMap(_hand_down)
    found = runs.join(paths, runs.getNumPartitions()).flatMap(lambda x: x[1][0].proofs(x[0], *x[1][1]))
    return spark.createDataFrame(found, RESULT, verifySchema=False)


def _partitions(spark: SparkSession, n: int) -> int:
    return max(n, min(4, spark.sparkContext.defaultParallelism))


def _hand_down(x: tuple) -> Iterator[tuple[Key, tuple]]:
    """What a node sends its children when its own path is there: root, its source's root, and the siblings by level up to the root."""
    key, (children, path) = x
    children, path = list(children), list(path)
    if not path:
        raise RuntimeError(f"node {key} got no path")
    if not children:
        yield key, path[0]
        return
    (root, subroot, above), nodes = path[0], children[0]
    names = [c[1] for c in nodes]
    tree, n, level, _ = key
    if root is None or (tree != TOP and width(n, level) == 1):
        here = digest(*names)
        root = root or here
        subroot = here if tree != TOP else subroot
    for i, (_, _, child) in enumerate(nodes):
        yield child, (root, subroot, (("".join(names[:i]), "".join(names[i + 1 :])), *above))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_leaf(text: str) -> str:
    fields = [text if name == "text" else f"CAST({name} AS VARCHAR)" for name in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END" for name, x in zip(FIELDS, fields, strict=True)) + ")"


#: Levels, and a leaf's way up through them, by recursion; crc32 bit by bit.
ORACLE_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc,
    {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered FROM documents
), l AS MATERIALIZED (
  SELECT doc_id, leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN lowered ELSE leaf END AS found,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), up(tree, lvl, pos, h) AS (
  SELECT tree, 0, pos, leaf FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, lvl, pos // 16
), subroots AS MATERIALIZED (SELECT tree, arg_max(h, lvl) AS subroot FROM up GROUP BY tree
), top(tree, lvl, pos, h) AS (
  SELECT CAST(-1 AS BIGINT), 0, tree, subroot FROM subroots
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY tree, lvl, pos // 16
), nodes AS (SELECT *, count(*) OVER (PARTITION BY tree, lvl) AS n FROM (SELECT * FROM up UNION ALL SELECT * FROM top)
), sib AS MATERIALIZED (
  SELECT tree, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt, tree >= 0 AND n <= 16 AS last
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, lvl, pos // 16 ORDER BY pos)
), way(k, tree, lvl, pos, h, proof) AS (
  SELECT l.tree || ' ' || l.pos, CASE WHEN s.tree IS NULL THEN -1 ELSE l.tree END, 0, CASE WHEN s.tree IS NULL THEN l.tree ELSE l.pos END, found, ''
  FROM l LEFT JOIN sib s ON s.tree = l.tree AND s.lvl = 0 AND s.pos = l.pos
  UNION ALL
  SELECT k, CASE WHEN last THEN -1 ELSE s.tree END, CASE WHEN last THEN 0 ELSE s.lvl + 1 END, CASE WHEN last THEN s.tree ELSE s.pos // 16 END, sha256(lft || h || rgt), proof || lft || rgt
  FROM way JOIN sib s ON s.tree = way.tree AND s.lvl = way.lvl AND s.pos = way.pos
), ends AS (SELECT k, arg_max(h, (strlen(proof), tree = -1, lvl)) AS folded_root, sha256(max_by(proof, (strlen(proof), tree = -1, lvl))) AS proof_sha256 FROM way GROUP BY k)
SELECT doc_id, leaf, subroot, (SELECT arg_max(h, lvl) FROM top) AS root, proof_sha256, folded_root, folded_root = (SELECT arg_max(h, lvl) FROM top) AS verified
FROM l JOIN subroots USING (tree) JOIN ends ON k = l.tree || ' ' || l.pos
"""
