import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import merkle_manifest as M

from .conftest import CLASHING, as_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climbed(nodes):
    """The root of some nodes, and for each the (left, right) siblings of each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, path in enumerate(paths):
            first = at[i] // 16 * 16
            path.append(("".join(level[first : at[i]]), "".join(level[at[i] + 1 : first + 16])))
            at[i] //= 16
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = ordered, *climbed([leaf(*r) for r in ordered])
    root, above = climbed([trees[s][1] for s in sources])
    found = []
    for s, top in zip(sources, above, strict=True):
        ordered, subroot, paths = trees[s]
        for r, path in zip(ordered, paths, strict=True):
            own = leaf(*r)
            if r[0] is not None and r[1] is not None and crc32(str(r[0]).encode()) % 5 == 0:
                own = leaf(r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in path + top:
                own = h(left, own, right)
            proof = h(*[x for pair in path + top for x in pair])
            found.append((r[0], leaf(*r), subroot, root, proof, own, own == root))
    return sorted(found, key=repr)


def table(n, sources, hot=0.0, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "src0" if rng.random() < hot else rng.choice(sources)
        text = rng.choice([None, "", "Plain Text É", "lower only", "ÀÉ only", "Łong " * 3000, f"Number {i}"])
        rows.append((i * 7 % 100_003, text, rng.choice([None, "en", "-"]), source, rng.choice([None, 0, 12, -5])))
    return rows


CASES = {
    "hot": table(2500, [None, "", "src0", "b", "é", "ａ", "𝕏"], hot=0.7),
    "many sources": table(400, [f"s{i}" for i in range(300)]),
    "one source": table(300, ["s"]),
    "sixteen": [(i, "A", "en", "s", 1) for i in range(16)],
    "one row": [(5, "Only", None, None, None)],
    "lone leaves": [(i, "A", "en", f"s{i}", 1) for i in range(17)],
    "repeated": [(3, "Same", "en", "s", 4)] * 40 + [(3, "Other", "en", "s", 5)] * 2 + [(None, "No id", "en", "s", 5), (None, None, None, None, None)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_plain_loops(spark, case, monkeypatch):
    rows = CASES[case]
    monkeypatch.setattr(M, "LEAF_ROWS", 300)
    shuffled = random.Random(3).sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, SCHEMA).repartition(5).select("*", *[F.lit("own").alias(c) for c in [*CLASHING, "tree", "at", "copy", "root"]])
    got = as_rows(M.manifest(docs))
    assert got == brute(rows)
    if case == "hot":
        changed = {r[0] for r in rows if r[1] and crc32(str(r[0]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in r[1])}
        assert {r[0] for r in got if not r[6]} == changed
        assert changed


@pytest.mark.parametrize("case", ["hot", "many sources", "one row", "lone leaves", "one source"])
def test_sql_says_the_same(spark, case, tmp_path):
    spark.createDataFrame(CASES[case], SCHEMA).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(M.ORACLE_SQL).fetchall(), key=repr) == brute(CASES[case])


def test_no_rows(spark, no_docs):
    assert M.manifest(no_docs).collect() == []


def test_places_of_a_large_source_come_from_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAF_ROWS", 100)
    rows = [(i, "x", "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(3000)]
    placed = M.leaves(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("tree", "at", "size", "doc_id").collect()
    hot = sorted((r["at"], r["doc_id"], r["size"]) for r in placed if r["size"] == 2000)
    assert [x[0] for x in hot] == list(range(2000)) and [x[1] for x in hot] == sorted(x[1] for x in hot)
