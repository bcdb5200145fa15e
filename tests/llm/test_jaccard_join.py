"""op7 against all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import common as C
from sensorloom.llm import jaccard_join as J
from sensorloom.llm.components import components

from .conftest import as_rows


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    lists = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            lists[x].append(n)
    common = Counter((a, b) for v in lists.values() for a in v for b in v if a < b)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    smallest = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(n)] = min(smallest.get(find(n), i), i)
    return sorted(((i, len(sets[n]), smallest.get(find(n), i)) for n, (i, _) in enumerate(rows)), key=repr)


def test_components_of_documents(edge_docs, edge_rows):
    assert as_rows(J.jaccard_components(edge_docs)) == brute(edge_rows)


def test_empty(no_docs):
    assert J.jaccard_components(no_docs).count() == 0


def test_one_stays(edge_docs, edge_rows):
    kept = J.one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    expected = {i for i, _, c in brute(edge_rows) if i is not None and i == c}
    assert set(ids) - {None} == expected and ids[None] == 2


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 62), (62, 60)]])
def test_graph_components(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((x, find(x)) for x in root)
    assert found.groupBy("node").count().filter(F.col("count") > 1).count() == 0


def pages(spark, n, own=16, shared=84):
    """Pages of one template whose own words keep them below the threshold."""
    template = [f"t{i}" for i in range(shared)]
    rows = [(i, " ".join([*template, *[f"p{i}w{k}" for k in range(own)]])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def opened_rows(spark, n):
    rows = C.stored(J.indexed_sets(pages(spark, n), 5, 80), "sets")
    postings = rows.filter("shared IS NOT NULL").select(F.col("signature").alias("node"), F.col("n_shingles").cast("int").alias("size"), F.explode("prefix").alias("p"))
    own = postings.select("p.token", "node", "size", "p.pos", F.col("node").alias("component"))
    lists = own.groupBy("token").count().agg(F.max("count")).first()[0]
    return lists, J._opened(own, 80).count()


def test_pages_of_a_template_do_not_meet(spark):
    """Lists as long as there are pages, but none of their positions can reach a set of their size."""
    small, large = opened_rows(spark, 100), opened_rows(spark, 400)
    assert small[0] == 100 and large[0] == 400
    assert small[1] == large[1] == 0
    found = J.jaccard_components(pages(spark, 60)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in found)


def test_answers_from_leaders_are_those_of_the_sets(spark):
    """Overlaps derived from the leaders' equal those of the sets themselves, for pairs within and between groups."""
    rng = random.Random(21)
    base = list(range(200))
    sets = {}
    for g in range(6):
        leader = set(rng.sample(base, 120)) | {1000 + g}
        sets[f"g{g}"] = (f"g{g}", leader)
        for k in range(5):
            sets[f"g{g}m{k}"] = (f"g{g}", (leader - set(rng.sample(sorted(leader), rng.randrange(1, 14)))) | set(rng.sample(base, rng.randrange(0, 14))))
    names = sorted(sets)
    table = spark.createDataFrame([(n, len(x), sorted(x)) for n, (_, x) in sets.items()], "node string, size int, shared array<long>")
    leaders = spark.createDataFrame([(n, len(x), lead, len(x - sets[lead][1])) for n, (lead, x) in sets.items()], "node string, size int, leader string, apart int")
    pairs = [(a, b) for a in names for b in names if a < b]
    for percent in (40, 45, 50, 80):
        got = {tuple(r) for r in J._answers(spark.createDataFrame(pairs, "a string, b string"), leaders, table, percent).collect()}
        assert got == {(a, b) for a, b in pairs if 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])}
