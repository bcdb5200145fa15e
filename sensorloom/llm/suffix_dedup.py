"""Removal of byte strings that an earlier document has, by sparse prefix doubling.

Prefix doubling ranks all positions by their first h bytes, then by pairs of
ranks at distance h, and drops a position once its rank is unique.  Here the
positions of the first round are a sample that every string of 50 bytes hits:
each window of 50 bytes has one 25-byte string of least hash in it, so equal
windows have equal samples at equal places.  The windows with one sample make a
segment of at most 75 bytes.  The rounds:

1. Rank the samples' 25 bytes; samples that no other position has are dropped,
   and all their windows with them.  (A sketch merged over all chunks decides;
   it may keep a unique sample, never drop a repeated one.)
2. Rank the pairs of sample and whole segment.  Where a sample occurs in one
   segment only, its windows occur together, and the segment's smallest
   document is theirs.
3. Where a sample occurs in several segments, rank their single windows of 50
   bytes; that is the threshold, so no round follows.

A phrase that many documents hold in other surroundings is one sample with as
many segments as documents.  So a chunk sends at most MANY + 1 pairs of a sample:
that it has more than one, or more than MANY, segments is told by these.  Windows
of samples with up to MANY segments are ranked where the sample's shard is, from
the segments' bytes; those of samples with more are ranked by digests of the
windows themselves, which spread evenly whatever the sample.

Between rounds, ranks go by their sorted digests to shards, which answer in the
same order; a document's bytes stay with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 50
#: Bytes handled at once in a chunk, so that arrays stay in the processor's cache.
STEP_BYTES = 1 << 17
#: Segments of a sample whose bytes may meet in the sample's shard.
MANY = 16

_POWERS = C.Powers(0x9E3779B97F4A7C15), C.Powers(0xD1B54A32D192ED03)
_BYTES = C.mixed(np.arange(1, 257, dtype=np.uint64)), C.mixed(np.arange(1001, 1257, dtype=np.uint64))
_PLACE = np.uint64(0xD6E8FEB86659FD93)
#: The low bits of a hash that hold a place within a step.
_PLACES = np.uint64((1 << 19) - 1)
#: Stands for a null doc_id, which is smaller than none.
_NO_ID = np.iinfo(np.int64).max


class Segments:
    """The segments of a chunk's texts, in the order of the texts.

    The texts are worked through in steps of STEP_BYTES window starts, so a long
    text takes no more memory than short ones.  A segment that a step cuts is
    two, which costs a few windows in round 3 and changes no result.
    """

    def __init__(self, texts: list[bytes], length: int, with_segment: bool = True):
        self.length = length
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.data = b"".join(texts)
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [self._part(a, with_segment) for a in range(0, max(0, len(self.data) - length + 1), STEP_BYTES)]
        self.sample, self.segment, self.start, self.windows = (np.concatenate(c) for c in zip(none, *parts, strict=True))
        self.text = np.searchsorted(self.ends, self.start, "right")

    def _part(self, base: int, with_segment: bool) -> tuple[np.ndarray, ...]:
        length, half = self.length, self.length // 2
        n_windows = min(STEP_BYTES, len(self.data) - length + 1 - base)
        data = np.frombuffer(self.data, np.uint8, n_windows + length - 1, base)
        hashes = C.window_sums(_BYTES[0][data], half, _POWERS[0])
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        # The leftmost least hash of each window, from spans that double; a place fits in the bits that its hash leaves.
        least, span, wide = (hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64), 1, length - half + 1
        while span < wide:
            step = min(span, wide - span)
            least = np.minimum(least[step:], least[:-step])
            span += step
        inside = np.ones(n_windows, bool)
        for end in self.ends[np.searchsorted(self.ends, base) : np.searchsorted(self.ends, base + n_windows + length, "right")].tolist():
            inside[max(0, end - length + 1 - base) : max(0, end - base)] = False
        window = np.flatnonzero(inside)
        place = (least[window] & _PLACES).astype(np.int64)
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
        start = window[new]
        windows = np.diff(np.append(new, len(window)))
        segment = np.zeros(len(new), np.uint64)
        if with_segment and len(new):
            end = start + windows - 1 + length
            up, down = _POWERS[1].get(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[1][data] * up[: len(data)], out=total[1:])
            shape = (place[new] - start).astype(np.uint64) << np.uint64(32) | windows.astype(np.uint64)
            segment = C.mixed((total[end] - total[start]) * down[start] + shape * _PLACE)
        return C.mixed(hashes[place[new]]), segment, start + base, windows

    def bytes_of(self, which: np.ndarray) -> bytes:
        size = self.windows[which] + self.length - 1
        return b"".join([self.data[a : a + n] for a, n in zip(self.start[which].tolist(), size.tolist(), strict=True)])


def _in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order of their own: steps cut segments at places that
    hang on it, and a shuffle gives rows in any order each time."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(_NO_ID).to_numpy()


class _Chunk:
    """A chunk in the rounds: its segments, and what the shards answered so far."""

    def __init__(self, table: pa.Table, sketch: C.Sketch, length: int, answers: pa.Table, many: int):
        self.ids = _doc_ids(table)
        s = self.segments = Segments(C.texts_of(table), length)
        # Round 2: the distinct (sample, segment) pairs of samples that may be repeated, and their smallest document here.
        self.kind = answers.column("kind").to_numpy()
        _, _, of = sketch.touched(s.sample)
        estimates = C.answers_of(self.of_kind(answers, 1))
        self.picked = np.flatnonzero(estimates[of].min(0)) if of.size else np.zeros(0, np.int64)
        self.order, self.group, begin = C.distinct_digests(s.sample[self.picked], s.segment[self.picked])
        self.at = self.picked[self.order][begin]
        ids = self.ids[s.text[self.picked]][self.order]
        self.smallest = np.minimum.reduceat(ids, begin) if len(begin) else ids
        # Pairs are in the samples' order: each one's number within its sample, and where that sample's pairs begin.
        sample = s.sample[self.at]
        first = np.flatnonzero(np.diff(sample, prepend=~sample[:1]) != 0)
        head = np.repeat(first, np.diff(np.append(first, len(sample))))
        self.sent = np.flatnonzero(np.arange(len(sample)) - head <= many)
        two = self.of_kind(answers, 2)
        told = C.answers_of(two, "b")
        if len(told) or not len(sample):
            self.first, kind = np.full(len(sample), _NO_ID), np.zeros(len(sample), np.int64)
            self.first[self.sent], kind[self.sent] = C.answers_of(two, "a").astype(np.int64), told
            kind = kind[head]
            self.one, self.several, self.many = (np.flatnonzero(kind == k) for k in range(3))

    def many_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ranks (first, second) of windows of samples with many segments, sorted and distinct, the smallest document
        of each here, and which of them each window is."""
        s, at = self.segments, self.at[self.many]
        n, data = s.windows[at], np.frombuffer(s.bytes_of(at), np.uint8)
        ranks = [_window_ranks(data[a:b], n[i:j], s.length) for a, b, i, j in _steps(n + s.length - 1)] if len(n) else []
        one, two = np.concatenate([np.zeros((2, 0), np.uint64), *ranks], axis=1)
        order, group, begin = C.distinct_digests(one, two)
        ids = np.repeat(self.smallest[self.many], n)[order]
        of = np.empty(len(order), np.int64)
        of[order] = group
        return one[order[begin]], two[order[begin]], np.minimum.reduceat(ids, begin) if len(begin) else ids, of

    def of_kind(self, answers: pa.Table, kind: int) -> pa.Table:
        return answers.filter(pa.array(self.kind == kind))


def remove_earlier_strings(docs: DataFrame, length: int = LENGTH, with_kept: bool = True, many: int = MANY) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes (50 or another
    even number) that also starts in a document with a smaller doc_id.

    ``docs`` needs doc_id and text.  Returns a row for each row of ``docs``:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and,
    if ``with_kept``, kept (the bytes left; they may cut a character).  Null and
    empty texts have 0 bytes; texts shorter than ``length`` lose nothing; tied
    or repeated rows, those with one doc_id, don't affect each other; a null
    doc_id is not smaller than any and loses nothing; an empty table gives an
    empty result; other columns, whatever their names, are left out.  A text is
    in one task whole, with some seven bytes of memory for each of its own and
    a step's arrays, so very long ones may have some 100 MB.  ``many``: see the
    module; it changes no result.
    """
    n_bytes = C.text_bytes(docs)
    sketch = C.Sketch(n_bytes / 12, C.repeated)
    shards = C.shard_count(n_bytes / 4)
    pairs = C.Exchange(shards, lambda sample, first: _rank_pairs(sample, first, many), least=True)
    spread = C.Exchange(shards, lambda first, number: (number,), least=True)
    chunks = C.chunked(docs, C.chunk_count(2 * n_bytes))
    by_chunk = chunks.groupBy("chunk")

    def sketched(key: tuple, table: pa.Table) -> pa.Table:
        return sketch.part(key[0].as_py(), Segments(C.texts_of(_in_order(table)), length, with_segment=False).sample)

    def with_kind(answers: DataFrame, kind: int) -> DataFrame:
        return answers.select(F.col("sender").alias("chunk"), F.lit(kind).alias("kind"), "dest", "n", "a", "b")

    answers_1 = with_kind(sketch.exchange.answered(by_chunk.applyInArrow(sketched, C.PART_SCHEMA)), 1)

    def pair_rows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(_in_order(table), sketch, length, answers, many)
        at = c.at[c.sent]
        return pairs.rows(key[0].as_py(), c.segments.sample[at], c.segments.segment[at], c.smallest[c.sent])

    sent_2 = by_chunk.cogroup(answers_1.groupBy("chunk")).applyInArrow(pair_rows, C.PART_SCHEMA)
    answers_2 = answers_1.unionByName(with_kind(pairs.answered(sent_2), 2))

    def windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """A row for each shard that windows go to, so never more rows than segments."""
        c = _Chunk(_in_order(table), sketch, length, answers, many)
        at = c.at[c.several]
        shard = (((c.segments.sample[at] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(at))
        spans = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table(
            {
                "shard": pa.array(shard[edges[:-1]]),
                "chunk": pa.array(np.full(len(spans), key[0].as_py(), np.int64)),
                "n": pa.array([x.stop - x.start for x in spans], pa.int32()),
                "sizes": pa.array([C.pack_ints(c.segments.windows[at[x]]) for x in spans], pa.binary()),
                "ids": pa.array([C.pack_ints(c.smallest[c.several[x]]) for x in spans], pa.binary()),
                "data": pa.array([c.segments.bytes_of(at[x]) for x in spans], pa.binary()),
            }
        )

    def rank_windows(table: pa.Table) -> pa.Table:
        sent = table.column("n").to_pylist()
        sizes, ids = ([C.unpack_ints(x, k).astype(np.int64) for x, k in zip(table.column(c).to_pylist(), sent, strict=True)] for c in ("sizes", "ids"))
        n = np.concatenate(sizes)
        ids = np.repeat(np.concatenate(ids), n)
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        ranks = np.concatenate([_window_ranks(data[a:b], n[i:j], length) for a, b, i, j in _steps(n + length - 1)], axis=1)
        order, group, begin = C.distinct_digests(*ranks)
        first = np.empty(len(ids), np.int64)
        first[order] = np.minimum.reduceat(ids[order], begin)[group]
        answered = [int(x.sum()) for x in sizes]
        return pa.table(
            {
                "sender": table.column("chunk"),
                "dest": table.column("shard"),
                "n": pa.array(answered, pa.int32()),
                "a": pa.array([C.pack_ints(x) for x in np.split(first, np.cumsum(answered)[:-1])], pa.binary()),
                "b": pa.nulls(len(sizes), pa.binary()),
            }
        )

    sent_3 = by_chunk.cogroup(answers_2.groupBy("chunk")).applyInArrow(windows, "shard long, chunk long, n int, sizes binary, ids binary, data binary")

    def window_rows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return spread.rows(key[0].as_py(), *_Chunk(_in_order(table), sketch, length, answers, many).many_windows()[:3])

    sent_4 = by_chunk.cogroup(answers_2.groupBy("chunk")).applyInArrow(window_rows, C.PART_SCHEMA)
    answers_3 = answers_2.unionByName(with_kind(sent_3.groupBy("shard").applyInArrow(rank_windows, C.ANSWER_SCHEMA), 3)).unionByName(with_kind(spread.answered(sent_4), 4))

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _in_order(table)
        c = _Chunk(table, sketch, length, answers, many)
        s = c.segments
        cover = np.zeros(len(s.data) + 1, np.int32)
        ids = c.ids[s.text[c.picked]][c.order]
        at = c.picked[c.order]
        single = np.zeros(len(c.at), bool)
        single[c.one] = True
        gone = single[c.group] & (c.first[c.group] < ids) & (ids != _NO_ID)
        _cover(cover, s.start[at[gone]], s.windows[at[gone]] + length - 1)
        # Segments whose windows were ranked one by one, in their sample's shard or by themselves.
        *_, of = c.many_windows()
        for pairs_, firsts in ((c.several, C.answers_of(c.of_kind(answers, 3))), (c.many, C.answers_of(c.of_kind(answers, 4))[of])):
            n = s.windows[c.at[pairs_]]
            begin = np.full(len(c.at), -1)
            begin[pairs_] = np.cumsum(n) - n
            one_by_one = np.flatnonzero(begin[c.group] >= 0)
            n = s.windows[at[one_by_one]]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(ids[one_by_one], n)
            gone = (firsts.astype(np.int64)[np.repeat(begin[c.group[one_by_one]], n) + within] < own) & (own != _NO_ID)
            start = (np.repeat(s.start[at[one_by_one]], n) + within)[gone]
            _cover(cover, start, np.full(len(start), length))
        drop = np.cumsum(cover, out=cover)[:-1] > 0
        data = np.frombuffer(s.data, np.uint8)
        rows = []
        for b, n in zip(s.ends.tolist(), s.sizes.tolist(), strict=True):
            d = drop[b - n : b]
            n_removed = int(np.count_nonzero(d))
            kept = data[b - n : b][~d].tobytes() if n_removed else s.data[b - n : b]
            spans = int(d[:1].sum()) + int(np.count_nonzero(d[1:] & ~d[:-1])) if n_removed else 0
            rows.append((n, n_removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        n, n_removed, spans, sha, kept = zip(*rows, strict=True) if rows else ((),) * 5
        columns = {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(n, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()),
        }
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return by_chunk.cogroup(answers_3.groupBy("chunk")).applyInArrow(removed, schema)


def _rank_pairs(sample: np.ndarray, first: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each (sample, segment) its smallest document, and whether the sample occurs in one (0), several (1) or many segments (2)."""
    of = np.cumsum(np.diff(sample, prepend=~sample[:1]) != 0) - 1
    n = np.bincount(of)[of]
    return first, (n > 1).astype(np.int64) + (n > many)


def _steps(sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of pieces of about STEP_BYTES: their first and last byte, their first and last number."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(STEP_BYTES, ends[-1], STEP_BYTES), "left"))
    numbers = np.unique(np.concatenate([[0], cuts, [len(sizes)]]))
    places = np.concatenate([[0], ends])[numbers]
    return list(zip(places[:-1].tolist(), places[1:].tolist(), numbers[:-1].tolist(), numbers[1:].tolist(), strict=True))


def _window_ranks(data: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit ranks of each window of pieces with ``n`` windows each."""
    begin = np.cumsum(n + length - 1) - (n + length - 1)
    start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([C.mixed(C.window_sums(b[data], length, p)[start]) for b, p in zip(_BYTES, _POWERS, strict=True)])


def _cover(cover: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Counts, by position, the runs that begin there less those that end there."""
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + sizes, -1)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_earlier_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
