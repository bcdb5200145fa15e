"""op4 and op9 against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sensorloom.llm import common as C
from sensorloom.llm import suffix_dedup as S
from sensorloom.llm.substring_dedup import remove_repeated_windows
from sensorloom.llm.suffix_dedup import remove_earlier_strings

from .conftest import as_rows


def brute_windows(rows, width):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in docs for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                keep[k : k + width] = [False] * width
        kept = b" ".join(x for x, y in zip(w, keep, strict=True) if y)
        out.append((i, len(w), keep.count(False), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_strings(rows, length):
    docs = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if i is not None and (s not in first or i < first[s]):
                first[s] = i
    out = []
    for i, b in docs:
        drop = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                drop[p : p + length] = b"\1" * length
        kept = bytes(c for c, d in zip(b, drop, strict=True) if not d)
        spans = sum(1 for p in range(len(b)) if drop[p] and (p == 0 or not drop[p - 1]))
        out.append((i, len(b), sum(drop), spans, hashlib.sha256(kept).hexdigest(), bytearray(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [35, 3])
def test_windows(edge_docs, edge_rows, width):
    assert as_rows(remove_repeated_windows(edge_docs, width)) == brute_windows(edge_rows, width)


@pytest.mark.parametrize("length", [50, 20])
def test_strings(edge_docs, edge_rows, length):
    assert as_rows(remove_earlier_strings(edge_docs, length)) == brute_strings(edge_rows, length)


@pytest.mark.parametrize("many", [0, 1, 3])
def test_samples_with_few_or_many_segments(edge_docs, edge_rows, monkeypatch, many):
    monkeypatch.setattr(C, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(C, "SHARD_VALUES", 5_000)
    assert as_rows(remove_earlier_strings(edge_docs, many=many)) == brute_strings(edge_rows, 50)


def phrase_rows(n, seed=3):
    """Documents of 1 kB with one phrase of 49 bytes among other bytes, and a passage that some share."""
    rng = random.Random(seed)
    phrase, passage = "".join(rng.choices("abcdefgh ", k=49)), "".join(rng.choices("abcdefgh ", k=80))
    letters = lambda k: "".join(rng.choices("ijklmnopqrstuvwxyz", k=k))
    return [(i, letters(500) + phrase + letters(450) + passage * (i % 50 == 0)) for i in range(n)]


def shard_sizes(n):
    """Pairs that each shard of round 2 gets, and windows of those samples by shard in round 3, of chunks of 500 documents."""
    sketch = C.Sketch(n * 80, C.repeated)
    pairs, windows = np.zeros(64, np.int64), np.zeros(64, np.int64)
    for a in range(0, n, 500):
        rows = phrase_rows(n)[a : a + 500]
        table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
        segments = S.Segments(C.texts_of(table), 50)
        cells, _, _ = sketch.touched(segments.sample)
        one = pa.table({"kind": [1], "sender": [0], "dest": [0], "n": pa.array([len(cells)], pa.int32()), "a": [C.pack_ints(np.ones(len(cells), np.uint64))], "b": pa.nulls(1, pa.binary())})
        c = S._Chunk(table, sketch, 50, one, S.MANY)
        sample = c.segments.sample[c.at]
        pairs += np.bincount((sample[c.sent] >> np.uint64(58)).astype(np.int64), minlength=64)
        _, number, count = np.unique(sample, return_inverse=True, return_counts=True)
        c.many = np.flatnonzero(count[number] > S.MANY)
        first, *_ = c.many_windows()
        windows += np.bincount((first >> np.uint64(58)).astype(np.int64), minlength=64)
    return pairs, windows


def test_no_shard_needs_all_segments_of_a_phrase():
    for n in (2000, 8000):
        pairs, windows = shard_sizes(n)
        assert windows.sum() > n * 20  # the phrase's windows, one by one
        assert pairs.max() < 1.3 * pairs.mean() and windows.max() < 1.3 * windows.mean()


def test_a_common_phrase(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(C, "SHARD_VALUES", 20_000)
    rows = phrase_rows(400)
    assert as_rows(remove_earlier_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute_strings(rows, 50)


def test_many_small_chunks(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(C, "SHARD_VALUES", 5_000)
    assert as_rows(remove_repeated_windows(edge_docs)) == brute_windows(edge_rows, 35)
    assert as_rows(remove_earlier_strings(edge_docs)) == brute_strings(edge_rows, 50)


def test_steps_within_texts(edge_docs, edge_rows, monkeypatch):
    from sensorloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 700)
    texts = [(t or "").encode() for _, t in edge_rows]
    short, (one, two) = suffix_dedup.Segments(texts, 50), (suffix_dedup.Segments([x], 50) for x in texts[:2])
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1 << 17)
    whole = suffix_dedup.Segments(texts, 50)
    expand = lambda s: sorted({(int(p), int(h)) for a, n, h in zip(s.start, s.windows, s.sample, strict=True) for p in range(a, a + n)})
    assert expand(short) == expand(whole) and one.windows.sum() == max(0, len(texts[0]) - 49) and two.windows.sum() == max(0, len(texts[1]) - 49)


def test_row_order_does_not_matter():
    from sensorloom.llm.suffix_dedup import _in_order

    rows = [(2, "b"), (1, None), (None, "c"), (1, "a"), (2, "a")]
    tables = [pa.table({"doc_id": [i for i, _ in r], "text": [t for _, t in r]}) for r in (rows, rows[::-1])]
    assert _in_order(tables[0]) == _in_order(tables[1])


def test_empty(no_docs):
    assert remove_repeated_windows(no_docs).count() == 0 and remove_earlier_strings(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 70_000, 1 << 40, (1 << 64) - 1])
def test_packed_numbers(n, top):
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, top, n, np.uint64, endpoint=True), np.where(rng.random(n) < 0.01, np.uint64(top), np.uint64(3))):
        assert (C.unpack_ints(C.pack_ints(x), n) == x).all()


def test_words_across_steps(monkeypatch):
    texts = [b" one two\x0bthree", b"", b"\n\t ", b"x" * 100 + b" yy " + b"z" * 55, b"ONE tWo"]
    whole = C.Words(texts, 2, lower=True)
    for step in (1, 2, 7, 50):
        monkeypatch.setattr(C, "STEP_BYTES", step)
        cut = C.Words(texts, 2, lower=True)
        assert [whole.data[a:b] for a, b in zip(cut.start, cut.end, strict=True)] == [w for x in texts for w in x.split()]
        assert cut.sizes.tolist() == [3, 0, 0, 3, 2] and all((a == b).all() for a, b in zip(cut.hashes, whole.hashes, strict=True))
    assert len(set(whole.hashes[0].tolist())) == 6 and whole.hashes[0][0] == whole.hashes[0][-2]


@pytest.mark.parametrize("fan_out", [3])
def test_several_hops(spark, edge_docs, edge_rows, monkeypatch, fan_out):
    monkeypatch.setattr(C, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(C, "SHARD_VALUES", 8_000)
    monkeypatch.setattr(C, "FAN_OUT", fan_out)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        assert as_rows(remove_repeated_windows(edge_docs)) == brute_windows(edge_rows, 35)
        assert as_rows(remove_earlier_strings(edge_docs)) == brute_strings(edge_rows, 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def simulated(size_gb: float):
    """Hops, rows and bytes a value of each hop, for one chunk and one node of an input of this size."""
    n_values = size_gb * 1e9 / 6
    sketch, rng, sent = C.Sketch(n_values, C.repeated), np.random.default_rng(1), []
    e = sketch.exchange
    table = sketch.part(0, rng.integers(0, 1 << 64, C.CHUNK_BYTES // 6, np.uint64))
    sent.append(table)
    for hop in range(2, e.hops + 1):  # a node's rows come from as many chunks as it has ranges, each with such a share of them
        low, high = (int(x) for x in e._bounds(np.array([1, 2]) * e.radix ** (e.hops - hop + 1)))
        share = [np.unique(rng.integers(low, high, C.CHUNK_BYTES // 6 // e.radix, np.uint64)) for _ in range(e.radix)]
        mine = pa.concat_tables([e.rows(c, x, None, np.ones(len(x), int), hop - 1) for c, x in enumerate(share)])
        first, _, number, _ = e._merged(mine, hop - 1)
        sent.append(e.rows(0, first, None, number, hop, 1))
    size = lambda t: sum(len(x) for c in ("keys", "number") for x in t.column(c).to_pylist()) + 56 * t.num_rows
    return e.hops, [(t.num_rows, size(t) / sum(t.column("n").to_pylist())) for t in sent]


def test_rows_and_bytes_stay_linear():
    found = {gb: simulated(gb) for gb in (0.5, 30, 300)}
    assert [found[gb][0] for gb in found] == [1, 1, 2]
    for hops, sent in found.values():
        assert len(sent) == hops and all(rows <= C.FAN_OUT and size < 4 for rows, size in sent)
    # Per hop, 300 GB take at most a fifth more than 30 GB do.
    per_hop = {gb: sum(size for _, size in sent) / hops for gb, (hops, sent) in found.items()}
    assert per_hop[300] < 1.2 * per_hop[30] and per_hop[30] < 1.5 * per_hop[0.5], per_hop


def test_equal_rows_share_no_chunk(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 1000, "doc_id long, text string").repartition(8)
    assert C.chunked(docs, 64).select("chunk").distinct().count() > 3
    assert {r["n_removed"] for r in remove_repeated_windows(docs, 2).collect()} == {3}


def test_counts_are_never_too_low():
    n = np.array([0, 1, 127, 128, 129, 10**6])
    assert (np.diff(C.count_code(n).astype(int)) >= 0).all() and C.count_code(n)[2] == 127
