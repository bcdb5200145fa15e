import itertools
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import language_id as L

from .conftest import as_rows

WORDS = {"en": "the and of that with from this have which".split(), "fr": "les des une dans pour avec que sont leur".split(), "ru": "это как все она так его только было".split()}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(WORDS) * 40)]
    rows += [(None, "the the", "en"), (900, None, "en"), (901, "the", None)]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(50):
        scores = rng.normal(size=(3, 6)) * 3
        value = lambda p: sum(scores[k, t] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=6), key=value)
        assert value(L.viterbi(scores, 2.0).tolist()) == pytest.approx(value(best))


def test_shortcut_agrees_with_viterbi(model, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS[rng.choice(list(WORDS)) if rng.random() < 0.2 else "fr"]) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    quick = model.label(texts).to_pylist()
    monkeypatch.setattr(L.LanguageModel, "_single", lambda self, s, w, f: np.full(w.n_texts, -1))
    assert model.label(texts).to_pylist() == quick


def plain_words(text):
    """(script, buckets) of each word, by plain loops."""
    text, found, n = "".join(text.lower()), [], len(text.lower())
    in_word = [unicodedata.category(c)[0] in "LM" for c in text]
    code = lambda i: ord(text[i]) if 0 <= i < n and in_word[i] else 0
    for i in range(n):
        if in_word[i]:
            mixed = (code(i - 1) * 0x9E3779B97F4A7C15 + code(i) * 0xC2B2AE3D27D4EB4F + code(i + 1) * 0x165667B19E3779F9) % 2**64
            if not code(i - 1):
                found.append((None, []))
            script = [name for start, name in L.SCRIPTS if start <= code(i)][-1]
            found[-1] = (found[-1][0] or script, [*found[-1][1], (mixed >> 48, script)])
    return found


def plain_model(rows):
    """lang -> (log probability of a bucket, scripts) by plain counting."""
    grams, scripts = {}, {}
    for _, text, lang in rows:
        for _, letters in plain_words(text):
            for bucket, script in letters:
                grams.setdefault(lang, Counter())[bucket] += 1
                scripts.setdefault(lang, Counter())[script] += 1
    every = sum(grams.values(), Counter())
    weight = lambda b: L.BACKGROUND * every[b] / every.total() + 0.05
    whole = L.BACKGROUND + 0.05 * L.BUCKETS
    return {k: ((lambda b, k=k: math.log((grams[k][b] + weight(b)) / (grams[k].total() + whole))), {x for x, n in scripts[k].items() if n >= L.SCRIPT_SHARE * scripts[k].total()}) for k in sorted(grams)}


def plain_label(model, text):
    """lang_pred and score by a plain pass over all (word, language)."""
    words = plain_words(text)
    used = set().union(*(scripts for _, scripts in model.values()))
    score = {k: [sum(p(b) for b, _ in letters) if script in scripts or script not in used else -math.inf for script, letters in words] for k, (p, scripts) in model.items()}
    paths = {k: (score[k][0], [k]) for k in model}
    for t in range(1, len(words)):
        paths = {k: max(((v - L.SWITCH_PENALTY * (j != k) + score[k][t], [*path, k]) for j, (v, path) in paths.items()), key=lambda x: x[0]) for k in model}
    _, path = max(paths.values(), key=lambda x: x[0])
    letters = Counter()
    for k, (_, own) in zip(path, words, strict=True):
        letters[k] += len(own)
    best = max(model, key=lambda k: (letters[k], sum(score[k])))
    return best, letters[best] / letters.total()


def test_fit_and_labels_against_plain_python(spark, small):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[lang] + ["αβγ"] * (i % 9 == 0)) for _ in range(30)), lang) for i, lang in enumerate(list(WORDS) * 20)]
    model, plain = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_documents=10**6), plain_model(rows)
    texts = [" ".join(rng.choice(WORDS[rng.choice(["en", "fr", "ru"][: 1 + i % 3])]) for _ in range(rng.randrange(1, 30))) for i in range(80)] + ["αβγ δ the", "das Haus", "это the", "日本"]
    assert [(x["lang_pred"], pytest.approx(x["score"])) for x in model.label(texts).to_pylist()] == [plain_label(plain, t) for t in texts]


def test_scripts_exclude_languages(model):
    """However likely letters are to the model of another script, its language isn't a candidate."""
    uses = model.uses
    model.uses = np.zeros_like(uses)
    model.uses[model.languages.index("ru"), L._NAMES.index("Latin")] = True
    model.uses[model.languages.index("en"), L._NAMES.index("Cyrillic")] = True
    try:
        assert [x["lang_pred"] for x in model.label(["the and of that " * 20, "это как все она " * 20]).to_pylist()] == ["ru", "en"]
        w = L._words(["the это αβγ"])
        scores = model._scores(w, np.diff(np.append(w.starts, len(w.buckets))))
        assert (scores > -np.inf).sum(0).tolist() == [1, 1, 3]
    finally:
        model.uses = uses


def test_mixed_spans_and_scripts(model):
    text = " ".join(WORDS["en"] * 4 + WORDS["ru"] * 4 + WORDS["fr"] * 2)
    (got,) = model.label([text]).to_pylist()
    assert [s["lang"] for s in got["spans"]] == ["en", "ru", "fr"] and got["lang_pred"] in ("en", "ru") and 0.3 < got["score"] < 0.6
    assert sum(s["n_words"] for s in got["spans"]) == len(text.split())


def test_edge_texts(model):
    texts = [None, "", " 123 !?", "é", "the", "the " * 50000, "日本", "\u0301"]
    got = model.label(texts).to_pylist()
    assert [g["lang_pred"] == "und" for g in got] == [True, True, True, False, False, False, False, True]
    assert all(0 <= g["score"] <= 1 for g in got) and got[5]["lang_pred"] == "en"


def test_no_training_rows(spark, no_docs):
    model = L.train(no_docs)
    rows = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert L.identify_languages(rows, model).first()["lang_pred"] == "und"
    assert L.identify_languages(no_docs, model).count() == 0


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = L.op1_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_edge_table(model, edge_docs, edge_rows):
    got = as_rows(L.identify_languages(edge_docs, model).select("doc_id", "held_out", "lang_pred"))
    assert len(got) == len(edge_rows)
    assert all(lang == "und" for i, _, lang in got if i in (200, 201, 202))


def test_more_languages_than_64(spark):
    rng = random.Random(3)
    own = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(90)}
    rows = [(3 * i + j, " ".join(rng.choices(own[lang], k=40)), lang) for i, lang in enumerate(own) for j in range(3 if i < 64 else 1)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(own)
    assert [x["lang_pred"] for x in model.label([" ".join(words) for words in own.values()]).to_pylist()] == list(own)
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(texts, model).collect()} == {i: lang for i, _, lang in rows}
