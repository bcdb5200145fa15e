"""Document quality learned from preferences.

A labelled pair, one document of label 1 and one of label 0, is a preference.
The Bradley-Terry model says that the first is preferred with the logistic
function of the difference of their scores; scores are linear in features of the
whole text, so the fit is a logistic loss on feature differences.  Every labelled
document that isn't held out is in pairs; they are dealt within buckets of
documents, and each of Newton's steps is one treeAggregate over their
differences.  The threshold between the labels is the quantile of all fitted
documents' scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import quantiles

from . import common as C

#: Labelled documents that the model is fitted on; None: all.
TRAIN_DOCUMENTS: int | None = None
#: Documents of the rarer label in a bucket that pairs are dealt in, in expectation.
BUCKET_DOCUMENTS = 2_000
#: Pairs that each document of the more frequent label is in.
PAIRS_EACH = 4
#: Weight of the squared weights beside the mean loss of a pair.
RIDGE = 1e-3
MAX_STEPS = 25
#: The score at the threshold.
CUT = 0.3
#: Bytes of text whose features are taken at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20

# Classes of bytes.
LOWER, UPPER, DIGIT, SPACE, BREAK, STOP, SYMBOL, WIDE = range(8)
_CLASS = np.full(256, SYMBOL, np.uint8)
_CLASS[128:] = WIDE
for _kind, _bytes in ((LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, [32, 9, 11, 12, 13]), (BREAK, [10]), (STOP, b".,;:?'\"-()")):
    _CLASS[list(_bytes)] = _kind

#: Names of the shares that features are made of; each counts as it is and as its root, so that rare things count too.
SHARES = ["lower", "upper", "digit", "space", "break", "stop", "symbol", "wide", "capital", "shouted", "symbolic", "ends_in_symbol", "no_letter", "single", "long", "as_1_before", "as_2_before", "as_3_before", "as_4_before"]
N_FEATURES = 2 * len(SHARES) + 2


def _per_text(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of flags over consecutive runs of ``sizes``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def features(texts: list[bytes]) -> np.ndarray:
    """texts x features: shares of kinds of bytes and words, repeated words, sizes.  An empty text has none, so all are 0."""
    words = C.Words(texts)
    kinds = _CLASS[np.frombuffer(words.data, np.uint8)]
    lengths = np.array([len(x) + 1 for x in texts], np.int64)
    inside = kinds.copy()
    inside[np.cumsum(lengths) - 1] = 255  # the line feed after each text is not its own
    n_bytes, n_words = np.maximum(lengths - 1, 1), np.maximum(words.sizes, 1)
    found = [_per_text(inside == k, lengths) / n_bytes for k in range(8)]
    if len(words.start):
        edges = np.stack([words.start, words.end], 1).ravel()
        count = lambda k: np.add.reduceat(kinds == k, edges, dtype=np.int32)[::2]
        lower, upper, wide, symbols = (count(k) for k in (LOWER, UPPER, WIDE, SYMBOL))
        size = words.end - words.start
        letters = lower + upper + wide
        of = np.repeat(np.arange(len(texts)), words.sizes)
        flags = [kinds[words.start] == UPPER, (upper > 1) & (lower == 0), (symbols > 0) & (letters > 0), kinds[words.end - 1] == SYMBOL, letters == 0, size == 1, size > 20]
        h = words.hashes[0]
        for back in range(1, 5):
            same = np.zeros(len(h), bool)
            same[back:] = (h[back:] == h[:-back]) & (of[back:] == of[:-back])
            flags.append(same)
    else:
        flags = [np.zeros(0, bool)] * (len(SHARES) - 8)
        size = np.zeros(0, np.int64)
    found += [_per_text(f, words.sizes) / n_words for f in flags]
    mean_size = _per_text(size, words.sizes) / n_words
    return np.stack([*found, *np.sqrt(found), np.log1p(words.sizes), np.log1p(mean_size)], 1)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, x in enumerate(texts):
        if i > first and size + len(x) > SLICE_BYTES:
            yield first, i
            first, size = i, 0
        size += len(x)
    if first < len(texts):
        yield first, len(texts)


def _features_of(batch: pa.RecordBatch) -> np.ndarray:
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    return np.concatenate([np.zeros((0, N_FEATURES)), *[features(texts[a:b]) for a, b in _slices(texts)]])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of all learning."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Model:
    """Weights of the features, and the utility at the threshold.  Without a pair to learn from there are no weights."""

    weights: np.ndarray | None
    threshold: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold, more for documents that would be preferred."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        at = x @ self.weights - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


# ---------------------------------------------------------------------- fit
def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the packed features x of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in _features_of(batch)], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x binary")


def _sample(docs: DataFrame, labels: DataFrame, bound: int | None = None) -> DataFrame:
    """quality and packed features of the labelled documents, equal ones once; with a ``bound``, of some as many."""
    return _labelled(featured(docs), labels, bound)


def _labelled(rows: DataFrame, labels: DataFrame, bound: int | None) -> DataFrame:
    """``_sample`` of featured rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.filter((F.col("quality") == F.col("other")) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("quality"))
    if bound:
        rate = bound / max(1, known.count())
        known = known.filter(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < F.lit(math.ceil(rate * (1 << 20))))
    seen = C.stored(rows.join(known, F.col("doc_id") == F.col("of")).select("doc_id", "quality", "x").distinct(), "quality-labelled")
    more = seen.count() / (2 * bound) if bound else 1  # only where many texts have one id
    return seen if more <= 1 else seen.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) / more)))


def _pairs(sample: DataFrame) -> DataFrame:
    """x of a document of label 1 and other of one of label 0: each document of the more frequent label with PAIRS_EACH
    of the other.

    They are dealt in buckets by a hash, BUCKET_DOCUMENTS of the rarer label in each, in turn, so that every document of
    either label is in pairs."""
    counts = {r["quality"]: r["n"] for r in sample.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return sample.select("x", F.col("x").alias("other")).limit(0)
    many = int(counts[1] >= counts[0])
    buckets = max(1, counts[1 - many] // BUCKET_DOCUMENTS)

    def dealt(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("x", "ascending")])
        mine, theirs = (table.column("x").combine_chunks().filter(pc.equal(table.column("quality").combine_chunks(), q)) for q in (many, 1 - many))
        n = len(theirs) and len(mine) * PAIRS_EACH
        turn = np.arange(n)
        a, b = mine.take(pa.array(turn // PAIRS_EACH)), theirs.take(pa.array(turn % max(1, len(theirs))))
        return pa.table({"x": a, "other": b} if many else {"x": b, "other": a})

    bucket, place = F.pmod(F.xxhash64("doc_id", "x"), F.lit(buckets)), F.xxhash64("x", "doc_id")
    return sample.select("doc_id", "quality", "x", bucket.alias("bucket"), place.alias("place")).groupBy("bucket").applyInArrow(dealt, "x binary, other binary")


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_FEATURES)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = _unpacked(batch.column("x")) - _unpacked(batch.column("other"))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in d], pa.binary())], ["d"])


def _loss_terms(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, squares of differences, gradient and curvature of the pairs' loss, one after the other."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the pair the other way round
    return np.concatenate([[len(d)], (d * d).sum(0), -(d.T @ p), ((d.T * (p * (1 - p))) @ d).ravel()])


def _both(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a + b


def _terms(pairs: DataFrame, w: np.ndarray) -> tuple | None:
    """The loss's terms over all pairs, a row of them from each partition; None without pairs."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = _both(total, _loss_terms(_unpacked(batch.column("d")), w))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["terms"])

    found = pairs.mapInArrow(part, "terms binary").rdd.treeAggregate(None, lambda acc, r: _both(acc, np.frombuffer(r["terms"])), _both)
    if found is None:
        return None
    return found[0], found[1 : N_FEATURES + 1], found[N_FEATURES + 1 : 2 * N_FEATURES + 1], found[2 * N_FEATURES + 1 :].reshape(N_FEATURES, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, bound: int | None = TRAIN_DOCUMENTS) -> Model:
    """The Bradley-Terry model of all labelled documents that aren't held out, or of some ``bound`` of them.

    Features are scaled by the spread of their differences; Newton's steps go on
    until they are short.  The threshold is the quantile of the fitted
    documents' utilities at the share of label 0.
    """
    return _fitted(_sample(docs, labels, bound))


def _fitted(sample: DataFrame) -> Model:
    """The model of labelled documents' features."""
    pairs = C.stored(_pairs(sample).mapInArrow(_differences, "d binary"), "quality-pairs")
    weights = np.zeros(N_FEATURES)
    scale = None
    for _ in range(MAX_STEPS):
        found = _terms(pairs, weights)
        if found is None:
            return Model(None)
        n, squares, gradient, curvature = found
        if scale is None:
            scale = np.sqrt(squares / n)
            scale[scale < 1e-9] = np.inf  # a feature that never differs gets no weight
        inner = 1 / scale
        g = gradient * inner / n + RIDGE * weights * np.where(np.isinf(scale), 0, scale)
        h = curvature * np.outer(inner, inner) / n + RIDGE * np.eye(N_FEATURES)
        step = np.linalg.solve(h, g) * inner
        weights = weights - step
        if np.abs(step * np.where(np.isinf(scale), 0, scale)).max() < 1e-6:
            break
    model = Model(weights)

    def utilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column("x"))
            yield pa.RecordBatch.from_arrays([pa.array(x @ model.weights), batch.column("quality")], ["u", "quality"])

    ranked = C.stored(sample.select("x", "quality").mapInArrow(utilities, "u double, quality int").withColumn("k", F.lit(0)), "quality-utilities")
    share = 1 - ranked.agg(F.avg("quality")).first()[0]
    model.threshold = quantiles.aggregated(ranked, ["k"], {"n": F.count("*")}, {"u": (F.col("u"), share)}, quantiles.large_groups(ranked, ["k"])).first()["u"]
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """Each document's score and whether it reaches the threshold.

    ``docs`` needs doc_id and text; other columns are not read, and a score hangs
    on the text alone.  Null texts are empty; an empty text's features are 0 and
    it is scored by them.  A whole text is one task's work and takes some thirty
    bytes for each of its own.  Equal texts have equal scores, repeated rows are
    scored each, rows without doc_id are scored and not held out; without a model
    (no labels, or of one kind only) all scores are 0.5.  An empty table gives
    an empty result.  Labels of a document that differ, or are neither 0 nor 1,
    are not learned from.
    """

    return _scored(featured(docs), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``quality`` of featured rows."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column("x"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    rows = rows.mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op13_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are taken once; the fit and the scores both read them."""
    rows = C.stored(featured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-features")
    return _scored(rows, _fitted(_labelled(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), TRAIN_DOCUMENTS)))
