import random

import pytest

from sensorloom.llm import decontamination as D


def last_row(pattern, text, anchored=False):
    """The least distance of ``pattern`` to what ends at each place of ``text``."""
    row = [j * anchored for j in range(len(text) + 1)]
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return row


def brute(pattern, text, limit=10**9):
    """The least distance, and where the first and shortest substring at that distance begins and ends; None above the limit."""
    row = last_row(pattern, text)
    end = row.index(min(row))
    if row[end] > limit:
        return None
    size = last_row(pattern[::-1], text[:end][::-1], True).index(row[end])
    return row[end], end - size, end


def test_myers_against_the_table():
    rng = random.Random(1)
    for _ in range(500):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        expected = brute(p, t)
        assert D.myers(p, t, 10**6)[0] == expected[0] and (expected[0] == len(p) or D.myers(p, t, 10**6) == expected)
        assert D.myers(p, t, expected[0] - 1) is None


def test_pieces_cover_the_item():
    for n in (1, 11, 12, 19, 20, 22, 23, 24, 30, 240, 1000):
        item = "".join(chr(97 + i % 26) for i in range(n))
        parts = D.pieces_of(item)
        assert "".join(x for _, x in parts) == item and len(parts) == D.error_budget(item) + 1 == n // 20 + 1


def test_short_item_with_one_edit(spark):
    item = "abcdefghij klmnopqrs"
    docs = [(1, f"xx {item} yy"), (2, "xx abcdefghij klmnopqr_ yy"), (3, "xx abcdefghij_klmnopqrs yy"), (4, "xx abcdefghi_ klmnopqr_ yy")]
    got = D.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(1, 9, 0), (2, 9, 1), (3, 9, 1)]


def test_place_of_an_item_with_a_gap(spark):
    item = "".join(chr(97 + i * i % 26) for i in range(60)) + "0123456789" * 2
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = D.find_items(spark.createDataFrame([(1, item[:5] + item[9:])], "doc_id long, text string"), items)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 4, 0, 76)]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(24))) for i in range(20)] + [(50, None), (51, ""), (52, "tiny"), (3, "one more text under an id")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(5, 200)))) for i in range(20)]
    for i in range(60, 100):
        item_id, item = items[i % 20]
        budget = D.error_budget(D.normalised(item))
        text = list(item)
        for _ in range(rng.randrange(0, budget * 2)):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice([[], ["q"], [text[k], "r"]])
        docs.append((i, "Start " + "".join(text).upper().replace(" ", "  \n") + " end " + " ".join(word() for _ in range(50))))
    docs += [(200, None), (201, ""), (60, docs[20][1]), (None, docs[21][1]), (202, "TINY")]
    return docs, items


def test_finds_what_the_table_finds(spark, case):
    docs, items = case
    got = D.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    expected = []
    for doc_id, text in docs:
        for item_id, item in items:
            if text and item:
                p, t = D.normalised(item), D.normalised(text)
                if found := brute(p, t, D.error_budget(p)):
                    expected.append((doc_id, item_id, found[0], found[1], found[2] - found[1]))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(expected, key=repr)


def test_drops_documents_and_works_in_parts(spark, case, monkeypatch):
    docs, items = case
    table, benchmark = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    flagged = {tuple(r)[0] for r in D.find_items(table, benchmark).collect()}
    monkeypatch.setattr(D, "AUTOMATON_CHARS", 3000)
    kept = D.without_items(table, benchmark)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if i not in flagged}


def test_empty(spark, no_docs):
    benchmark = spark.createDataFrame([(1, "some item of text")], "item_id long, text string")
    assert D.find_items(no_docs, benchmark).count() == 0 and D.without_items(no_docs, benchmark.limit(0)).count() == 0
