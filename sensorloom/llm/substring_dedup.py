"""Removal of repeated word windows with a count-min prefilter.

First pass: each chunk of documents makes a count-min sketch of its windows'
hashes; the sketches merge by cell, and each window's estimate, the least of its
counters and never too low, goes back to its chunk.  Second pass: only windows
estimated repeated are grouped exactly, by 128-bit digests of their words.  So
no repeated window is lost, and about one unique window in seventy is grouped
for nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW_WORDS = 35
#: No word and its separator take fewer bytes than this on average in prose; only the sketch's width follows from it.
BYTES_PER_WORD = 6
#: Rows of the sketch, and counters in a row for each window.
SKETCH_ROWS = 2
SKETCH_COUNTERS = 8

_POWERS = C.Powers(0x9E3779B97F4A7C15), C.Powers(0xD1B54A32D192ED03)


class _Windows:
    """The words of a chunk's texts, the numbers of the words where a window
    starts, and one or both digests of each window."""

    def __init__(self, texts: list[bytes], width: int, n_digests: int = 2):
        self.words = C.Words(texts, n_digests)
        sizes = self.words.sizes
        last = np.repeat(np.cumsum(sizes) - width, sizes)  # the last start of a window in the word's document
        self.starts = np.flatnonzero(np.arange(len(last)) <= last)
        self.digests = [C.mixed(C.window_sums(h, width, p)[self.starts]) for h, p in zip(self.words.hashes, _POWERS, strict=False)]
        self.words.hashes = []


def remove_repeated_windows(docs: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """Remove each word that a window of ``width`` words covers whose words
    also start anywhere else, in the same document too.

    ``docs`` needs doc_id and text.  Returns a row for each row of ``docs``:
    doc_id, n_words, n_removed, kept_text (the words left, joined by a space)
    and kept_sha256.  Null and empty texts have no words and give an empty
    kept_text; texts shorter than a window lose nothing; of tied windows none
    stays; repeated rows repeat each other; a null doc_id stays null; an empty
    table gives an empty result; other columns, whatever their names, are left
    out.  A text is handled whole in one task, with about ten bytes of memory
    for each of its own, so very long ones may have some 100 MB.
    """
    n_bytes = C.text_bytes(docs)
    sketch = C.Sketch(n_bytes / BYTES_PER_WORD, C.repeated, SKETCH_COUNTERS, SKETCH_ROWS)
    exact = C.Exchange(C.shard_count(n_bytes / BYTES_PER_WORD / 4), C.repeated)
    chunks = C.chunked(docs, C.chunk_count(n_bytes))
    by_chunk = chunks.groupBy("chunk")

    def sketched(key: tuple, table: pa.Table) -> pa.Table:
        return sketch.part(key[0].as_py(), _Windows(C.texts_of(table), width, 1).digests[0])

    estimates = sketch.exchange.answered(by_chunk.applyInArrow(sketched, C.PART_SCHEMA))
    estimates = estimates.select(F.col("sender").alias("chunk"), F.lit(1).alias("kind"), "dest", "n", "a")

    def candidates(table: pa.Table, answers: pa.Table):
        """The windows estimated repeated: their numbers, and the order, groups and first ones of their digests."""
        w = _Windows(C.texts_of(table), width)
        _, _, of = sketch.touched(w.digests[0])
        answer = C.answers_of(answers)
        picked = np.flatnonzero(answer[of].min(0)) if of.size else np.zeros(0, np.int64)
        return w, picked, *C.distinct_digests(*(d[picked] for d in w.digests))

    def exact_parts(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        w, picked, order, group, begin = candidates(table, answers)
        at = picked[order][begin]
        return exact.rows(key[0].as_py(), w.digests[0][at], w.digests[1][at], np.bincount(group, minlength=len(begin)))

    verdicts = exact.answered(by_chunk.cogroup(estimates.groupBy("chunk")).applyInArrow(exact_parts, C.PART_SCHEMA))
    both = estimates.unionByName(verdicts.select(F.col("sender").alias("chunk"), F.lit(2).alias("kind"), "dest", "n", "a"))

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy()
        w, picked, order, group, _ = candidates(table, answers.filter(pa.array(kind == 1)))
        repeated = C.answers_of(answers.filter(pa.array(kind == 2)))
        cover = np.zeros(len(w.words.start) + width + 1, np.int32)
        if len(picked):
            at = w.starts[picked[order][repeated[group] > 0]]
            cover[at] += 1
            cover[at + width] -= 1
        keep = np.cumsum(cover)[: len(w.words.start)] == 0
        left, kept = _kept_texts(w.words, keep)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(w.words.sizes),
                "n_removed": pa.array(w.words.sizes - left),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
        )

    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(removed, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def _kept_texts(words: C.Words, keep: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """How many of each text's words are kept, and those joined by a space."""
    data = np.frombuffer(words.data, np.uint8).copy()
    start, end = words.start[keep], words.end[keep]
    data[end] = 0x20  # a byte that is no word's follows each word
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end + 1] -= 1
    data = data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
    bounds = np.concatenate([[0], np.cumsum(words.sizes)])
    ends = np.concatenate([[0], np.cumsum(end - start + 1)])
    numbers = np.concatenate([[0], np.cumsum(keep)])[bounds]
    cuts = ends[numbers].tolist()
    return np.diff(numbers), [data[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
