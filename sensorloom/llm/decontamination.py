"""Benchmark passages in documents, exact or slightly edited.

Pigeonhole: a passage within k edits of an item, cut into k + 1 pieces, holds
at least one piece unchanged.  An automaton finds all pieces of all items in
one pass over a document; where a piece is found, Myers' bit-parallel distance
decides whether the whole item is there within its budget.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edits allowed, as a share of an item's characters.
ERROR_SHARE = 0.05
#: Characters of items that one automaton holds; more items take more passes.
AUTOMATON_CHARS = 4 << 20

HIT_SCHEMA = "doc_id long, item_id long, distance int, first_char long, n_chars long"


def normalised(text: str) -> str:
    """Lower case, and each run of white space as one space."""
    return " ".join(text.lower().split())


def pieces_of(item: str, share: float = ERROR_SHARE) -> list[tuple[int, str]]:
    """(offset, piece): one more piece than the errors allowed, about equally long."""
    parts = error_budget(item, share) + 1
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def error_budget(item: str, share: float = ERROR_SHARE) -> int:
    """Edits that an item may have: its share, rounded down, and always fewer than its characters."""
    return min(int(len(item) * share), len(item) - 1)


def _distances(m: int, text: Iterable[str], masks: dict[str, int], anchored: bool) -> Iterator[int]:
    """Myers' bit-parallel recurrence for a pattern of ``m`` characters: after
    each character of ``text`` the least edit distance of the pattern to what
    ends there and begins anywhere, or, if ``anchored``, where ``text`` does."""
    full, top, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    plus, minus, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        carried = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | (full & ~(carried | plus))
        h_minus = plus & carried
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus, h_minus = ((h_plus << 1) | first) & full, (h_minus << 1) & full
        plus, minus = h_minus | (full & ~(vertical | h_plus)), h_plus & vertical
        yield score


def myers(pattern: str, text: str, limit: int, masks: dict[str, int] | None = None) -> tuple[int, int, int] | None:
    """The least edit distance of ``pattern`` to any substring of ``text``, and
    where that begins and ends, or None if the distance is over ``limit``.  Of
    equally near substrings it is one that ends first, of those the shortest."""
    best, end = limit + 1, 0
    for at, score in enumerate(_distances(len(pattern), text, pattern_masks(pattern) if masks is None else masks, False)):
        if score < best:
            best, end = score, at + 1
    if best > limit:
        return None
    back = _distances(len(pattern), reversed(text[:end]), pattern_masks(pattern[::-1]), True)
    size = next((n for n, score in enumerate(back, 1) if score == best), 0)
    return best, end - size, end


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


class Items:
    """Some benchmark items, bounded by AUTOMATON_CHARS, and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items = items
        self.budgets = [error_budget(x, share) for _, x in items]
        self.masks = [pattern_masks(x) for _, x in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, item) in enumerate(items):
            for offset, piece in pieces_of(item, share):
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first character, characters) of each item in a
        normalised text at its best place, the first of equally good ones."""
        spots: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                spots[i].add(end + 1 - size - offset)
        found = []
        for i, starts in spots.items():
            (item_id, item), k = self.items[i], self.budgets[i]
            if (at := text.find(item)) >= 0:
                found.append((item_id, 0, at, len(item)))
                continue
            best = None
            for a, b in _merged((max(0, x - k), min(len(text), x + len(item) + k)) for x in sorted(starts)):
                hit = myers(item, text[a:b], k if best is None else best[0] - 1, self.masks[i])
                if hit:
                    best = (hit[0], a + hit[1], hit[2] - hit[1])
            if best:
                found.append((item_id, *best))
        return sorted(found)


def _merged(ranges: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Sorted ranges with overlapping ones joined."""
    current = None
    for a, b in ranges:
        if current and a <= current[1]:
            current = (current[0], max(b, current[1]))
        else:
            if current:
                yield current
            current = (a, b)
    if current:
        yield current


def _parts(items: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    part: list[tuple[int, str]] = []
    size = 0
    for item in items:
        if part and size + len(item[1]) > AUTOMATON_CHARS:
            yield part
            part, size = [], 0
        part.append(item)
        size += len(item[1])
    if part:
        yield part


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """Which items are in which documents.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; both texts
    are compared in lower case with white space as single spaces.  An item may
    differ by ``share`` of its characters, rounded down, in edits.  Returns a
    row for each document row and item found: doc_id, item_id, distance,
    first_char and n_chars of the best place in the normalised text.  Of places
    tied in distance it is the first one found, at its first end and shortest.
    Null or empty texts and items match nothing; an empty table gives an empty
    result; repeated rows are each judged; of equal item rows one counts; other
    columns, whatever their names, are left out.  A text is read whole in one
    task, however long, with a few bytes of memory for each character.  The
    benchmark is read on the driver part by part, as many passes over ``docs``
    as it has parts of AUTOMATON_CHARS characters.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    result = docs.sparkSession.createDataFrame([], HIT_SCHEMA)
    for part in _shared_parts(benchmark):
        result = result.unionByName(_find_part(texts, part, share))
    return result


def _shared_parts(benchmark: DataFrame) -> Iterator:
    """The items in broadcast parts of AUTOMATON_CHARS characters each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct().orderBy("item_id", "text")
    items = ((r["item_id"], x) for r in rows.toLocalIterator() if (x := normalised(r["text"])))
    for part in _parts(items):
        yield benchmark.sparkSession.sparkContext.broadcast(part)


def _find_part(texts: DataFrame, part, share: float) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(part.value, share)
        for batch in batches:
            hits = [
                (doc_id, *hit)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                for hit in items.find(normalised(text.as_py()))
            ]
            columns = list(zip(*hits, strict=True)) if hits else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "first_char", "n_chars"])

    return texts.mapInArrow(find, HIT_SCHEMA)


def without_items(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds an item; rows with a null text stay."""
    for part in _shared_parts(benchmark):
        docs = docs.filter(~_holds_item(part, share)(F.col("text")))
    return docs


def _holds_item(part, share: float):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(part.value, share)
        for texts in batches:
            yield pa.array([x.is_valid and bool(items.find(normalised(x.as_py()))) for x in texts], pa.bool_())

    return holds


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
