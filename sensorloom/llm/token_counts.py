"""Token counts through a cache keyed by content and tokenizer version.

A count depends on nothing but a text's bytes and the tokenizer, so it is
stored under the digests of both.  Texts are joined to the stored counts, each
distinct text that has none is encoded once, and its count is appended.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TOKEN_LIMIT = 512
#: Bytes of text handed to the tokenizer at once.
SLICE_BYTES = 1 << 20

#: Where a text can be cut: before a single space between printable ASCII characters.  And how many parts' counts a task remembers.
PART = re.compile(r"(?<=[!-~])(?= [!-~])")
MEMO_PARTS = 400_000

CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens long"


class TokenizerFile:
    """A tokenizer's file, read on the driver: its digest and how to count with it.

    The digest covers the file and the library's version, so counts of another
    version are never used.
    """

    def __init__(self, path: str):
        self.kind = "tokenizers" if path.endswith(".json") else "sentencepiece"
        self.content = Path(path).read_bytes()
        version = f"{self.kind} {importlib.metadata.version(self.kind)}\n".encode()
        self.digest = hashlib.sha256(version + self.content).hexdigest()

    def counter(self):
        """texts -> numbers of tokens, without begin, end or added special tokens."""
        if self.kind == "tokenizers":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_buffer(self.content)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            whole = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return PartCounter(whole).count if self.splits_at_spaces() else whole
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=self.content)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


    def splits_at_spaces(self) -> bool:
        """Whether a single space between two other characters always begins a
        new word for this tokenizer, so that counts of the parts add up: byte-level
        words, no normaliser, and no added token that takes, holds or looks for a space."""
        rules = json.loads(self.content)
        words = rules.get("pre_tokenizer") or {}
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
        return plain and not rules.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules.get("added_tokens", []))


#: The counter of the tokenizer that a Python worker used last; its memory serves the worker's next tasks.
_LAST: dict[str, Callable[[list[str]], list[int]]] = {}


def _counter(tokenizer: TokenizerFile) -> Callable[[list[str]], list[int]]:
    if tokenizer.digest not in _LAST:
        _LAST.clear()
        _LAST[tokenizer.digest] = tokenizer.counter()
    return _LAST[tokenizer.digest]


class PartCounter:
    """Counts texts by their parts, remembering the parts' counts."""

    def __init__(self, whole):
        self.whole = whole
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        cut = [PART.split(x) for x in texts]
        new = list({p for parts in cut for p in parts if p not in self.memo})
        if len(self.memo) + len(new) > MEMO_PARTS:
            self.memo = {}
            new = list({p for parts in cut for p in parts})
        self.memo.update(zip(new, self.whole(new), strict=True))
        get = self.memo.__getitem__
        return [sum(map(get, parts)) for parts in cut]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """Each document's bytes and tokens.

    ``docs`` needs doc_id and text.  ``cache_path`` names a Parquet table that
    is made where it is missing; it may hold several tokenizers' counts and, if
    two runs appended the same text, equal rows.  Content is normalised only in
    that null counts as empty, as any other change could change a count.

    Returns a row for each row of ``docs``: doc_id, n_bytes, n_tokens.  Empty
    texts have 0 of both; equal texts, tied or repeated rows, are encoded once
    and counted each; an empty table gives an empty result; other columns,
    whatever their names, are left out.  A text goes to the tokenizer whole, so
    a very long one takes what the library needs for it.
    """
    spark = docs.sparkSession
    tokenizer = TokenizerFile(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(cache_path)

    def stored_counts() -> DataFrame:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        return cache.filter(F.col("tokenizer_digest") == tokenizer.digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    misses = (
        keyed.groupBy("content_digest")
        .agg(F.first("text").alias("text"))
        .join(stored_counts().select("content_digest"), "content_digest", "left_anti")
    )
    shared = spark.sparkContext.broadcast(tokenizer)  # one vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared.value)
        for batch in batches:
            counts: list[int] = []
            for part in _slices(batch.column("text").to_pylist()):
                counts += count(part)
            digest = pa.array([shared.value.digest] * len(counts), pa.string())
            yield pa.RecordBatch.from_arrays(
                [digest, batch.column("content_digest"), pa.array(counts, pa.int64())], ["tokenizer_digest", "content_digest", "n_tokens"]
            )

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counted = keyed.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # Only these documents' counts, and kept apart from the join, so that a text with very many copies can be split there.
    counts = C.stored(stored_counts().join(keyed.select("content_digest").distinct(), "content_digest", "left_semi"), "distinct-counts")
    return counted.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None, cache_path: str | None = None) -> DataFrame:
    """Without ``cache_path`` a cache of its own in the shared folder, so a run's work doesn't hang on earlier ones."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = cache_path or f"{C.scratch_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    counts = count_tokens(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
