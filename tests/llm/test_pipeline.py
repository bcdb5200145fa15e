"""The pipeline's stages, each on what the one before kept."""

import itertools
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sensorloom.llm import common, decontamination, line_dedup, piece_encoding

from .test_decontamination import last_row
from .test_jaccard_join import brute as brute_components
from .test_language_id import plain_label, plain_model
from .test_piece_encoding import brute as brute_pieces


CLASHING = ["_label", "label", "row", "line_dedup", "node", "component", "chunk", "ids"]


def plain_lines(docs):
    """doc_id -> text without recurring lines, by the operator's SQL for which lines go."""
    connection = duckdb.connect()
    connection.register("documents", pa.table({"doc_id": pa.array(list(docs), pa.int64()), "text": pa.array(list(docs.values()), pa.string())}))
    sql = line_dedup.ORACLE_SQL.replace("sha256(text) AS kept_sha256", "text")
    return {i: text for i, _, _, text in connection.sql(sql).fetchall()}


def test_stages_against_brute_force(spark, small):
    """Each stage's rows are what plain loops make of the rows before it."""
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r["text"] is None or len(r["text"]) < 2500]
    docs = spark.createDataFrame(rows).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(common.stored(stage(spark, tables[-1], small), f"test-{name}"))
        assert tables[-1].columns == docs.columns
        assert all(r[c] == f"own {c}" for r in tables[-1].collect() for c in CLASHING)
    given, spoken, lines, groups, clean = ({r["doc_id"]: r for r in t.collect()} for t in tables)
    assert all(t.count() == len(found) for t, found in zip(tables, (given, spoken, lines, groups, clean), strict=True))
    text_of = lambda found: {i: r["text"] for i, r in found.items()}

    labelled = [(i, r["text"], r["lang"]) for i, r in given.items() if r["lang"] and r["text"] and zlib.crc32(str(i).encode()) % 5]
    model = plain_model(labelled)
    has_letter = lambda x: x is not None and any(c.isalpha() for c in x)
    assert set(spoken) == {i for i, x in text_of(given).items() if has_letter(x) and plain_label(model, x)[1] >= corpus_pipeline.MIN_LANGUAGE_SHARE}

    left = plain_lines(text_of(spoken))
    assert text_of(lines) == {i: x for i, x in left.items() if x == spoken[i]["text"] or x.strip(" ")}
    assert all(r["n_chars"] == (spoken[i]["n_chars"] if r["text"] == spoken[i]["text"] else len(r["text"])) for i, r in lines.items())

    assert set(groups) == {i for i, _, c in brute_components(list(text_of(lines).items())) if i == c}

    items = [decontamination.normalised(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {i for i, x in text_of(groups).items() if any(holds(item, decontamination.normalised(x)) for item in items)}
    assert held and set(clean) == set(groups) - held

    encoded = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, tables[-1], small).collect()}
    assert set(encoded) == set(clean) and all(r["round_trip"] for r in encoded.values())
    vocabulary = piece_encoding.load_vocabulary()
    score = dict(zip(vocabulary.ids.tolist(), vocabulary.scores.tolist(), strict=True))
    for i in sorted(clean)[:40]:
        expected = brute_pieces(vocabulary, clean[i]["text"])
        assert sum(score.get(x, 0) for x in encoded[i]["ids"]) == pytest.approx(sum(score.get(x, 0) for x in expected))


def holds(item, text):
    """Whether an item is in a text within its edits: the table, where a piece that has no edit is there."""
    budget = decontamination.error_budget(item)
    parts = budget + 1
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return any(item[a:b] in text for a, b in itertools.pairwise(cuts)) and min(last_row(item, text)) <= budget


def test_run(spark, small):
    encoder = piece_encoding.Encoder(piece_encoding.load_vocabulary())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(docs)
    assert all(set(encoder.decode(__import__("numpy").array(r["ids"], "int32").tobytes()).split("\n")) <= set(docs[r["doc_id"]].split("\n")) for r in rows)


def test_empty_table(spark, small, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, small).count() == 0
