import math
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import quality_ranking as Q

from .conftest import as_rows

LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    """The features of one text, character by character and word by word."""
    data = text.encode()
    kind = lambda b: (
        "wide" if b >= 128 else "lower" if chr(b).islower() else "upper" if chr(b).isupper() else "digit" if chr(b).isdigit() else "break" if b == 10
        else "space" if b in (32, 9, 11, 12, 13) else "stop" if chr(b) in ".,;:?'\"-()" else "symbol"
    )
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    share = {k: 0 for k in Q.SHARES}
    for b in data:
        share[kind(b)] += 1 / max(1, len(data))
    for i, w in enumerate(words):
        kinds = [kind(b) for b in w]
        upper, lower, wide = (kinds.count(k) for k in ("upper", "lower", "wide"))
        flags = {
            "capital": kinds[0] == "upper", "shouted": upper > 1 and not lower, "symbolic": "symbol" in kinds and upper + lower + wide > 0,
            "ends_in_symbol": kinds[-1] == "symbol", "no_letter": not upper + lower + wide, "single": len(w) == 1, "long": len(w) > 20,
        } | {f"as_{k}_before": i >= k and words[i - k] == w for k in range(1, 5)}
        for k, on in flags.items():
            share[k] += on / len(words)
    s = [share[k] for k in Q.SHARES]
    return [*s, *map(math.sqrt, s), math.log1p(len(words)), math.log1p(sum(map(len, words)) / max(1, len(words)))]


TEXTS = ["", " ", "\n", "One two two one two.", "SHOUT!! É!! 12 a-b (c) x|y", "ab " * 400 + "\n\n", "über Über ÜBER\tTab\x0bVt", "w" * 30, "a b a b a b c", "🙂 🙂🙂 .", "z" * 100_000]


def test_features_are_those_of_plain_loops():
    expected = np.array([plain(t) for t in TEXTS])
    assert np.allclose(Q.features([t.encode() for t in TEXTS]), expected, atol=1e-12)
    for t, row in zip(TEXTS, expected, strict=True):
        assert np.allclose(Q.features([t.encode()]), row, atol=1e-12)


def test_slices_cover_every_text():
    texts = [b"x" * n for n in (0, 5 << 20, 1, 3 << 20, 2 << 20, 0)]
    cuts = list(Q._slices(texts))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(6))
    assert all(b == a + 1 or sum(map(len, texts[a:b])) <= Q.SLICE_BYTES for a, b in cuts)


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, Q.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    rows = Q.quality(docs, model)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    seen = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(seen) > 700 and rows.count() == docs.count()
    assert auc(seen.score.to_numpy(), seen.quality.to_numpy()) > 0.999
    assert (seen.predicted == seen.quality).mean() > 0.99
    assert ((seen.score >= 0.3) == (seen.predicted == 1)).all() and seen.score.between(0, 1).all()
    assert all(crc32(str(i).encode()) % 5 == 0 for i in seen.doc_id)


def test_the_fit_is_the_minimum_of_the_loss(spark, fitted):
    docs, labels, _ = fitted
    few = docs.filter("doc_id < 1500")
    model = Q.fit(few, labels)
    d = np.concatenate([np.frombuffer(r["x"]) - np.frombuffer(r["other"]) for r in Q._pairs(Q._sample(few, labels, Q.TRAIN_DOCUMENTS)).collect()]).reshape(-1, Q.N_FEATURES)
    scale = np.sqrt((d * d).mean(0))
    used = scale >= 1e-9
    z, w = d[:, used] / scale[used], model.weights[used] * scale[used]
    loss = lambda w: np.logaddexp(0, -z @ w).mean() + Q.RIDGE / 2 * w @ w
    slope = -(z.T @ (1 / (1 + np.exp(z @ w)))) / len(z) + Q.RIDGE * w
    assert np.abs(slope).max() < 1e-6
    assert all(loss(w) <= loss(w + e) for e in 0.01 * np.random.default_rng(1).normal(size=(20, len(w))))


def test_the_threshold_is_the_quantile_at_the_share_of_label_0(spark, fitted):
    docs, labels, model = fitted
    rows = [(np.frombuffer(r["x"]) @ model.weights, r["quality"]) for r in Q._sample(docs, labels, Q.TRAIN_DOCUMENTS).collect()]
    u, y = (np.array(c) for c in zip(*rows, strict=True))
    assert model.threshold == pytest.approx(np.quantile(u, 1 - y.mean()), abs=1e-9)


def test_held_out_and_doubtful_labels_teach_nothing(spark, fitted):
    docs, labels, model = fitted
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    odd = spark.createDataFrame([(None, 0, 0), (10**9, 0, 0), (3, None, 0), (4, 7, 0)], LABELS)
    other = Q.fit(docs.withColumn("lang", F.lit("xx")).withColumn("x", F.lit(0)).withColumn("of", F.lit(1)), turned.unionByName(odd).unionByName(labels.limit(50)).unionByName(turned.limit(0)))
    same = [i for i in range(len(model.weights)) if abs(model.weights[i] - other.weights[i]) < 1e-6]
    assert len(same) == len(model.weights)
    unsure = Q._sample(docs, labels.unionByName(labels.withColumn("quality", 1 - F.col("quality"))), 1000)
    assert unsure.count() == 0


def test_edge_rows(spark, edge_docs, edge_rows, fitted):
    got = as_rows(Q.quality(edge_docs, fitted[2]).select("doc_id", "score"))
    x = Q.features([(t or "").encode() for _, t in edge_rows])
    want = sorted(((i, float(s)) for (i, _), s in zip(edge_rows, fitted[2].scores(x), strict=True)), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])
    assert Q.quality(edge_docs, fitted[2]).filter("doc_id IS NULL AND held_out").count() == 0


@pytest.mark.parametrize("rows", [[], [(i, 1, 0) for i in range(100, 130)], [(i, None, None) for i in range(100, 130)]])
def test_nothing_to_learn_from(spark, edge_docs, rows):
    model = Q.fit(edge_docs, spark.createDataFrame(rows, LABELS))
    assert {(r["score"], r["predicted"]) for r in Q.quality(edge_docs, model).collect()} == {(0.5, 1)}


def test_no_documents(spark, no_docs):
    model = Q.fit(no_docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS))
    assert Q.quality(no_docs, model).collect() == []


def test_many_texts_of_one_id_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(1, f"word {i} " * (i % 9)) for i in range(3000)] + [(2, "!! $$ AA!! " * 5)] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    assert Q._sample(docs, labels, 40).count() < 200


def test_every_labelled_document_teaches(spark, tmp_path, monkeypatch):
    """More labelled documents than were once picked, of each label, and in several buckets: all are in pairs, and the
    threshold is that of all."""
    monkeypatch.setattr(Q, "BUCKET_DOCUMENTS", 1000)
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.expr("repeat('ab ', cast(id % 7 as int))"), F.when(F.col("id") % 3 == 0, "$$ !").otherwise("end."), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    learned = [i for i in range(n) if crc32(str(i).encode()) % 5]
    rows = Q._sample(docs, labels, Q.TRAIN_DOCUMENTS)
    assert sorted(r["doc_id"] for r in rows.select("doc_id").collect()) == learned
    pairs = Q._pairs(rows)
    assert pairs.count() == Q.PAIRS_EACH * sum(i % 3 != 0 for i in learned)
    for q, side in ((1, "x"), (0, "other")):
        assert pairs.select(side).distinct().count() == rows.filter(f"quality = {q}").select("x").distinct().count()
    model = Q.fit(docs, labels)
    u = np.array([np.frombuffer(r["x"]) @ model.weights for r in rows.collect()])
    assert model.threshold == pytest.approx(np.quantile(u, np.mean([i % 3 == 0 for i in learned])), abs=1e-9)
