import random

import duckdb
import pytest

from sensorloom.llm import line_dedup

from .conftest import as_rows


def test_templates_with_variable_fields(spark):
    rows = [(i, f"own line number {chr(97 + i)} {chr(97 + i)}\nPage {i} of the site was served today\nkeep {chr(97 + i) * 3}") for i in range(8)]
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Page 0 of" in got[0]["text"] and all("Page" not in got[i]["text"] for i in range(1, 8))
    assert got[3]["line_dedup"]["n_lines"] == 3 and got[3]["line_dedup"]["n_dropped"] == 1 and got[3]["text"].endswith("keep ddd")


@pytest.mark.parametrize("n", [20, 200, 2000])
def test_popular_field_values(spark, n):
    names, cities, days = ("abcdefghij", "klmnopqrst", "uvwxyzäöüß")
    line = "contact our desk through {} about any {} order on {} today please now or later this very week"
    pick = random.Random(1).choice
    texts = [line.format(pick(names), pick(cities), pick(days)) for _ in range(n)]
    one_of_two = [f"we open this shop {('early', 'late')[i % 2]} on every morning of the week" for i in range(n)]
    rows = [(i, f"{a}\n{b}\nown line {'x' * (i + 1)} {'y' * (i + 1)}") for i, (a, b) in enumerate(zip(texts, one_of_two, strict=True))]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum("contact" in r["text"] for r in got) == 1
    assert sum("we open" in r["text"] for r in got) == 2  # values as common as this stay two templates
    assert all("own line" in r["text"] for r in got)


def test_rare_exact_copies_among_popular_templates(spark):
    """A line in few documents, most of whose tokens are far more common, keeps its own template."""
    words = [["red", "green", "blue", "black"], ["one", "two", "three", "four"], ["north", "south", "east", "west"], ["day", "night", "noon", "dawn"]]
    popular = [(i, "this is a " + " ".join(w[(i + k) % 3] for k, w in enumerate(words)) + " x") for i in range(300)]
    rare = [(1000 + i, "this is a " + " ".join(w[3] for w in words) + " x") for i in range(6)]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(popular + rare, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] >= 1000 and r["text"]) == [1000]


def test_few_documents_keep_their_lines(spark):
    rows = [(i, "the same line\n" + "x" * i) for i in range(4)] + [(9, "again\nagain\nagain\nagain\nagain\nagain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in line_dedup.drop_recurring_lines(df).collect()} == set(rows)


def test_wildcards_alone_are_no_template(spark):
    rows = [(i, f"{i} {i + 1} {i + 2}\n") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.drop_recurring_lines(df).filter("line_dedup.n_dropped > 0").count() == 0


def test_edges(spark, edge_docs, edge_rows, no_docs):
    kept = line_dedup.drop_recurring_lines(edge_docs)
    assert kept.columns == [*edge_docs.columns, "line_dedup"]
    got = as_rows(kept.select("doc_id", "text", "line_dedup.n_lines", "row", "gone"))
    assert len(got) == len(edge_rows) and all(r[3:] == ("own row", "own gone") for r in got)
    by_id = {r[0]: r for r in got if r[0] in (200, 201, 202)}
    assert by_id[200][1:3] == (None, 0) and by_id[201][1:3] == ("", 1) and by_id[202][1] == " \t\n "
    assert line_dedup.drop_recurring_lines(no_docs).count() == 0


@pytest.mark.parametrize("table", ["small"])
def test_sql(spark, request, table):
    folder = request.getfixturevalue(table)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = sorted(connection.sql(line_dedup.ORACLE_SQL).fetchall(), key=repr)
    assert as_rows(line_dedup.op2_line_dedup(spark, folder)) == expected
    assert any(r[2] for r in expected)
