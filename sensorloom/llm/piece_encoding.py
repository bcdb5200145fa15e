"""Unigram encoding and decoding with a SentencePiece vocabulary.

A text's spaces become whitespace markers and the text is cut where no piece
can cross: before a marker that follows another character, and around
characters that are in no longer piece.  The best segmentation of the whole is
then the best of each segment, so a segment is encoded once per task.  All new
segments of a batch go through a double-array trie and a Viterbi pass together,
as numpy arrays.  Characters without a piece fall back to their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "▁"
#: How much less an unknown character scores than the worst piece.
UNKNOWN_PENALTY = 10.0
#: The offset of the Zipf-Mandelbrot law: a piece of rank r has a probability in proportion to 1 / (r + offset).
ZIPF_OFFSET = 2.7
#: Segments that a task remembers, and the longest one that it does.
MEMO_SEGMENTS = 400_000
MEMO_CHARS = 64
#: Characters encoded at once.
SLICE_CHARS = 1 << 19


#: Free places that the children of a state are tried at before they go to the end.
PROBES = 100


class DoubleArray:
    """A trie over bytes in two arrays: the child of state s by byte c is
    base[s] + c if check has s there.  ``value`` has a key's number, or -1."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, key in enumerate(keys):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = number
        size = 300 * 256 + 4 * len(children)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free = top = 1
        todo = [(0, 0)]
        for node, state in todo:  # breadth first; grows
            value[state] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            free = used.index(0, free)
            slot, at = free, -1
            for _ in range(PROBES):
                if slot > codes[0] and not any(used[slot - codes[0] + c] for c in codes):
                    at = slot - codes[0]
                    break
                slot = used.index(0, slot + 1)
            if at < 0:
                at = top  # nothing from here on is used
            base[state] = at
            for c in codes:
                used[at + c] = 1
                check[at + c] = state
            top = max(top, at + codes[-1] + 1)
            if top + 1024 > len(used):
                base, check, value = (np.append(x, np.full(size, f, np.int32)) for x, f in ((base, 0), (check, -1), (value, -1)))
                used += bytearray(size)
            todo += [(children[node][c], at + c) for c in codes]
        base, check, value = (x[: top + 256].copy() for x in (base, check, value))
        self.base, self.check, self.value = base, check, value

    def matches(self, data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, key) of every key that begins at one of ``starts`` in
        ``data`` and ends at ``ends`` of that start or before."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, state, depth = starts, np.zeros(len(starts), np.int64), 0
        stop = ends
        while len(at):
            inside = at + depth < stop
            at, state, stop = at[inside], state[inside], stop[inside]
            step = self.base[state] + data[at + depth]
            ok = self.check[step] == state
            at, state, stop, depth = at[ok], step[ok], stop[ok], depth + 1
            key = self.value[state]
            hit = key >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), key[hit]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


class Vocabulary:
    """Pieces, log scores and ids of a SentencePiece file.

    A unigram model stores its pieces' log probabilities.  Those of another
    kind store ranks, which are no log scores; their pieces get the log
    probability that the Zipf-Mandelbrot law gives to their rank.  Nothing is
    trained.  Files with a normaliser's character map, removal of extra white
    space or markers as suffixes are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(Path(path).read_bytes())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies with an identity normaliser and prefix markers are supported")
        self.pieces = [p.piece for p in model.pieces]
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.ids = np.array([i for i, _ in normal], np.int32)
        self.scores = np.array([p.score for _, p in normal], np.float64)
        if model.trainer_spec.model_type != model.trainer_spec.UNIGRAM:
            self.scores = zipf_scores(self.scores)
        self.unknown_score = float(self.scores.min(initial=0.0)) - UNKNOWN_PENALTY
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_ids = np.full(256, -1, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids) if i >= 0}
        texts = [p.piece for _, p in normal]
        self.trie = DoubleArray([x.encode() for x in texts])
        self.segments = _segmenter(texts)


def zipf_scores(scores: np.ndarray) -> np.ndarray:
    """Log probabilities by rank; the highest score has the first rank, of equal scores the first."""
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
    weight = 1 / (rank + ZIPF_OFFSET)
    return np.log(weight / weight.sum()) if len(scores) else scores


def _segmenter(pieces: list[str]) -> re.Pattern:
    """Matches the segments that no piece can cross."""
    longer = [x for x in pieces if len(x) > 1]
    inside = set("".join(longer))
    if any(MARKER in x.lstrip(MARKER) for x in longer):
        return re.compile(r"(?s).+")
    word = "".join(re.escape(c) for c in sorted(inside - {MARKER}))
    return re.compile(f"(?s){MARKER}+[{word}]*|[{word}]+|.") if word else re.compile(f"(?s){MARKER}+|.")


class Encoder:
    """Encodes texts of one task; remembers segments."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        v = self.v
        cut = []
        for x in texts:
            marked = x.replace(" ", MARKER)
            cut.append(v.segments.findall(MARKER + marked if v.dummy_prefix and marked else marked))
        new = {s for segments in cut for s in segments if s not in self.memo}
        if len(self.memo) + len(new) > MEMO_SEGMENTS:
            self.memo = {}
            new = {s for segments in cut for s in segments}
        self.memo.update(self._encode_segments(list(new)))
        out = [b"".join([self.memo[s] for s in segments]) for segments in cut]
        if (v.byte_ids < 0).any():  # no byte pieces: a run of unknown characters is one unknown piece
            for i, ids in enumerate(np.frombuffer(x, np.int32) for x in out):
                out[i] = ids[(ids != v.unknown) | (np.append(-1, ids[:-1]) != v.unknown)].tobytes()
        for s in new:
            if len(s) > MEMO_CHARS:
                del self.memo[s]
        return out

    def _encode_segments(self, segments: list[str]) -> dict[str, bytes]:
        if not segments:
            return {}
        v, raw = self.v, [s.encode("utf-8", "surrogatepass") for s in segments]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        n = len(data)
        ends = np.cumsum(sizes)
        head = np.repeat(ends - sizes, sizes)  # where each byte's segment begins
        stop = np.repeat(ends, sizes)
        letters = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(letters, n))
        start, length, key = v.trie.matches(data, stop[letters], letters)
        score, ids = v.scores[key], v.ids[key]
        # A character that is no piece by itself may be an unknown one.
        single = np.zeros(n + 1, bool)
        width_at = np.zeros(n + 1, np.int64)
        width_at[letters] = width
        single[start[length == width_at[start]]] = True
        lone = letters[~single[letters]]
        start, length = np.append(start, lone), np.append(length, width_at[lone])
        score, ids = np.append(score, np.full(len(lone), v.unknown_score)), np.append(ids, np.full(len(lone), v.unknown, np.int32))
        # Viterbi over all segments at once: matches in the order of their end in the segment; of equal ones the longest stays.
        end = start + length
        order = np.lexsort((start, end, end - head[start]))
        start, end, score, ids = start[order], end[order], score[order], ids[order]
        reach = end - head[start]
        cuts = np.flatnonzero(np.diff(reach, prepend=-1))
        best = np.full(n + 1, -np.inf)  # of a segment's first k bytes, at its k-th byte
        via = np.full(n + 1, -1, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(reach)), strict=True):
            s, e = start[a:b], end[a:b]
            total = np.where(s == head[s], 0.0, best[s - 1]) + score[a:b]
            group = np.flatnonzero(np.diff(e, prepend=-1))
            top = np.maximum.reduceat(total, group)
            is_top = np.flatnonzero(total == np.repeat(top, np.diff(np.append(group, b - a))))
            first = is_top[np.flatnonzero(np.diff(e[is_top], prepend=-1))]
            best[e[first] - 1] = total[first]
            via[e[first] - 1] = a + first
        # Back from all segments' ends together.
        at = ends[sizes > 0] - 1
        picked = []
        while len(at):
            m = via[at]
            picked.append(m)
            at = start[m] - 1
            at = at[start[m] != head[start[m]]]
        used = np.sort(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
        used = used[np.argsort(start[used], kind="stable")]
        p_start, p_end, p_ids = start[used], end[used], ids[used]
        if (v.byte_ids >= 0).all():  # unknown characters as their bytes
            many = np.where(p_ids == v.unknown, p_end - p_start, 1)
            which = np.repeat(np.arange(len(p_ids)), many)
            within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            as_bytes = v.byte_ids[data[p_start[which] + within]]
            p_ids = np.where(p_ids[which] == v.unknown, as_bytes, p_ids[which])
            p_start = p_start[which] + within * (many[which] > 1)
        edges = np.searchsorted(p_start, np.append(0, ends))
        p_ids = p_ids.astype(np.int32)
        return {s: p_ids[a:b].tobytes() for s, a, b in zip(segments, edges[:-1], edges[1:], strict=True)}

    def decode(self, ids: bytes) -> str:
        """The text of some ids: pieces joined, byte pieces as UTF-8, markers as
        spaces, and without the dummy prefix."""
        v, out, run = self.v, [], bytearray()
        for i in np.frombuffer(ids, np.int32).tolist():
            b = v.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(v.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        if v.dummy_prefix and text.startswith(MARKER):
            text = text[1:]
        return text.replace(MARKER, " ")


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = True) -> DataFrame:
    """Each document's piece ids, and whether they decode to the text again.

    ``docs`` needs doc_id and text; null counts as empty and has no pieces.
    Returns a row for each row of ``docs``: doc_id, n_tokens, n_bytes_fallback
    (byte pieces), ids (array<int>, if ``with_ids``), ids_sha256 (of the ids as
    little-endian int32), round_trip: the decoded text equals the text, taking
    a marker character that the text itself holds as a space.  Equal texts,
    repeated rows too, have equal ids; of tied segmentations the one whose last
    pieces are longest is taken; an empty table gives an empty result; other
    columns, whatever their names, are left out.  A text without a place to cut
    is one segment and takes some 200 bytes for each of its own, so a very long
    one may have some 5 MB; others are only held whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file
    schema = "doc_id long, n_tokens long, n_byte_fallback long" + ", ids array<int>" * with_ids + ", ids_sha256 string, round_trip boolean"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        is_byte = np.zeros(len(shared.value.pieces), bool)
        is_byte[shared.value.byte_ids[shared.value.byte_ids >= 0]] = True
        for batch in batches:
            at = 0
            for texts in _slices([x or "" for x in batch.column("text").to_pylist()]):
                ids = encoder.encode(texts)
                flat = np.frombuffer(b"".join(ids), np.int32)
                edges = np.cumsum([0] + [len(x) // 4 for x in ids])
                byte_runs = np.concatenate([[0], np.cumsum(is_byte[flat])])
                columns = {
                    "doc_id": batch.column("doc_id").slice(at, len(texts)),
                    "n_tokens": pa.array(np.diff(edges)),
                    "n_byte_fallback": pa.array(byte_runs[edges[1:]] - byte_runs[edges[:-1]]),
                    "ids": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat)),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "round_trip": pa.array([encoder.decode(i) == x.replace(MARKER, " ") for i, x in zip(ids, texts, strict=True)]),
                }
                if not with_ids:
                    del columns["ids"]
                at += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for batch in batches:
            yield pa.array([encoder.decode(np.array(x or [], np.int32).tobytes()) for x in batch.to_pylist()], pa.string())

    return encoded.select("doc_id", decoded(F.col("ids")).alias("text"))


def load_vocabulary(path: str | None = None) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Vocabulary(path)


def op8_piece_encoding(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, load_vocabulary(vocabulary_path), with_ids=False)
