import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorloom.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_and_cache(spark, edge_docs, edge_rows, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    rows = edge_docs.unionByName(edge_docs.limit(1).withColumn("doc_id", F.lit(400)).withColumn("text", F.lit("a<|endoftext|>b")))
    tokenizer = Tokenizer.from_file(PATH)
    expected = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in [*edge_rows, (400, "a<|endoftext|>b")]), key=repr)
    got = sorted((tuple(r) for r in T.count_tokens(rows, PATH, cache).collect()), key=repr)
    assert got == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in [*edge_rows, (400, "a<|endoftext|>b")]})
    # A second run finds all counts and encodes nothing; rows that two runs both appended do no harm.
    stored.limit(5).write.mode("append").parquet(cache)
    before = spark.read.parquet(cache).count()
    assert sorted((tuple(r) for r in T.count_tokens(rows, PATH, cache).collect()), key=repr) == expected
    assert spark.read.parquet(cache).count() == before


def test_another_tokenizer_has_its_own_counts(spark, tmp_path):
    cache, docs = str(tmp_path / "cache"), spark.createDataFrame([(1, "Some words, here.")], "doc_id long, text string")
    T.count_tokens(docs, PATH, cache)
    other = public_tokenizers.path("piece_bpe_32k.model")
    from sentencepiece import SentencePieceProcessor

    assert T.count_tokens(docs, other, cache).first()["n_tokens"] == len(SentencePieceProcessor(model_file=other).encode("Some words, here."))
    assert spark.read.parquet(cache).count() == 2


def test_empty(no_docs, tmp_path):
    assert T.count_tokens(no_docs, PATH, str(tmp_path / "cache")).count() == 0


def test_over_limit(spark, small):
    got = T.op3_token_counts(spark, small)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.filter("over_limit <> (n_tokens > 512)").count() == 0


def test_parts_add_up(small, spark):
    import random

    rng = random.Random(6)
    pieces = ["a", "the", "'s", "'t", " ", " ", "  ", "\n", "\t", "é", "日", "\u00a0", "\u3000", "\x1c", "12", ".", "!!", "🙂", "<|endoftext|>", "<|endof", "text|>", "Ab", "\u180e", "\u200b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    tokenizer = Tokenizer.from_file(PATH)
    file = T.TokenizerFile(PATH)
    assert file.splits_at_spaces() and not T.TokenizerFile(public_tokenizers.path("word_bpe_49k.json")).splits_at_spaces()
    assert file.counter()(texts) == [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
