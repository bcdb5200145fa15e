"""Language identification of whole texts, mixed-language ones too.

Script ranges narrow each word's candidate languages to those that use its
script, letter trigrams score the word in each candidate, and a Viterbi pass with a penalty for switching labels spans of
words.  Scoring is numpy over whole batches; the Viterbi pass itself runs only
for texts where some other language could pay for a switch.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each language that the model is fitted on, in expectation.
TRAIN_DOCUMENTS = 2000
#: Bytes of text that are labelled at once with up to so many languages; with more languages, fewer bytes.
LABEL_BYTES, LABEL_LANGUAGES = 1 << 19, 64
#: Log probability that a switch of language costs.
SWITCH_PENALTY = 24.0
#: A language uses a script that at least this share of its letters has.
SCRIPT_SHARE = 0.01
BUCKETS = 1 << 16
#: Letters' worth of all languages together that smooth each one.
BACKGROUND = 200.0

UNDETERMINED = "und"

# First code points of blocks, in order, and the script that begins there.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C00, "Other"), (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
]
_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
_SCRIPT_OF = np.array([_NAMES.index(name) for _, name in SCRIPTS])


@cache
def _in_words() -> np.ndarray:
    """By code point: 0 not part of a word, 1 a letter, 2 a mark on one."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


@dataclass
class _Words:
    """The words of a batch of texts."""

    n_texts: int
    buckets: np.ndarray  # trigram bucket of each letter
    starts: np.ndarray  # of each word, in letters
    script: np.ndarray  # of each word
    text: np.ndarray  # of each word
    has_letter: np.ndarray  # of each text
    letter_script: np.ndarray = field(repr=False)


def _words(texts: list[str | None]) -> _Words:
    joined = "\n".join("" if x is None else x.lower() for x in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([0 if x is None else len(x.lower()) for x in texts], np.int64)
    ends = np.cumsum(lengths + 1)
    kinds = _in_words()[codes]
    padded = np.zeros(len(codes) + 2, np.uint64)
    padded[1:-1] = np.where(kinds > 0, codes, 0)
    at = np.flatnonzero(kinds)
    mixed = padded[at] * np.uint64(0x9E3779B97F4A7C15) + padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 2] * np.uint64(0x165667B19E3779F9)
    buckets = (mixed >> np.uint64(48)).astype(np.int64)
    starts = np.flatnonzero(padded[at] == 0)
    text = np.searchsorted(ends, at[starts], "right")
    letter_script = _SCRIPT_OF[np.searchsorted(_STARTS, codes[at], "right") - 1]
    has = np.zeros(len(texts), bool)
    has[np.unique(np.searchsorted(ends, at[kinds[at] == 1], "right"))] = True
    return _Words(len(texts), buckets, starts, letter_script[starts], text, has, letter_script)


@dataclass
class LanguageModel:
    """Letter-trigram log probabilities of each language, and the scripts it uses.

    A language holds only the buckets that it was seen in, at most BUCKETS, and
    takes the others from what all languages share.
    """

    languages: list[str]
    shared: np.ndarray  # BUCKETS, float64: log weight of a bucket that a language was not seen in
    total: np.ndarray  # of each language: log of its weights' sum
    seen: list[tuple[np.ndarray, np.ndarray]]  # of each language: buckets (uint16), log probabilities (float32)
    uses: np.ndarray  # languages x scripts, bool

    def row(self, k: int) -> np.ndarray:
        """The log probabilities of language ``k`` in all buckets."""
        out = (self.shared - self.total[k]).astype(np.float32)
        buckets, values = self.seen[k]
        out[buckets] = values
        return out

    def label(self, texts: list[str | None]) -> pa.Array:
        """For each text a struct of lang_pred, score (the share of letters in
        spans of that language) and spans (language, first word, words)."""
        w, n_lang = _words(texts), len(self.languages)
        size = np.diff(np.append(w.starts, len(w.buckets)))
        scores = self._scores(w, size)
        first = np.searchsorted(w.text, np.arange(w.n_texts + 1))
        out: list[dict] = []
        one = self._single(scores, w, first)
        for i in range(w.n_texts):
            a, b = first[i], first[i + 1]
            if not w.has_letter[i] or a == b or not n_lang:
                out.append({"lang_pred": UNDETERMINED, "score": 0.0, "spans": []})
                continue
            if one[i] >= 0:
                out.append({"lang_pred": self.languages[one[i]], "score": 1.0, "spans": [{"lang": self.languages[one[i]], "first_word": 0, "n_words": int(b - a)}]})
                continue
            path = viterbi(scores[:, a:b], SWITCH_PENALTY)
            letters = np.bincount(path, size[a:b], n_lang)
            best = int(np.lexsort((-scores[:, a:b].sum(1), -letters))[0])
            cut = np.append(np.flatnonzero(np.diff(path, prepend=-1)), b - a)
            spans = [{"lang": self.languages[path[s]], "first_word": int(s), "n_words": int(e - s)} for s, e in zip(cut[:-1], cut[1:], strict=True)]
            out.append({"lang_pred": self.languages[best], "score": float(letters[best] / letters.sum()), "spans": spans})
        return pa.array(out, _LABEL_TYPE)

    def _scores(self, w: _Words, size: np.ndarray) -> np.ndarray:
        """languages x words: the sum of a word's log probabilities, and minus
        infinity where the language isn't a candidate for it.  A word's
        candidates are the languages that use its script, or all languages if
        none does; others are not scored."""
        scores = np.full((len(self.languages), len(w.starts)), -np.inf)
        if not len(w.starts):
            return scores
        unused = ~self.uses.any(0)
        for k, out in enumerate(scores):
            fits = (self.uses[k] | unused)[w.script]
            if fits.all():
                out[:] = np.add.reduceat(self.row(k)[w.buckets], w.starts, dtype=np.float64)
            elif fits.any():
                starts = np.cumsum(size[fits]) - size[fits]
                out[fits] = np.add.reduceat(self.row(k)[w.buckets[np.repeat(fits, size)]], starts, dtype=np.float64)
        return scores

    def _single(self, scores: np.ndarray, w: _Words, first: np.ndarray) -> np.ndarray:
        """The one language of each text for which that is sure to be the best
        path, else -1.  With k the best language overall, each detour through j
        gains at most the largest rise of the running sum of j's lead over k; if
        no rise is over half the penalty, no path with switches beats staying."""
        best = np.full(w.n_texts, -1)
        full = np.flatnonzero(np.diff(first))
        if not len(full) or not len(scores):
            return best
        totals = np.add.reduceat(scores, first[full], axis=1)
        best[full] = np.where(totals.max(0) > -np.inf, totals.argmax(0), -1)
        own = scores[best[w.text], np.arange(scores.shape[1])]
        own[best[w.text] < 0] = np.inf  # no language fits all words: decided already
        floor = -w.text * 1e9  # lets one running minimum restart at each text
        for j in range(len(scores)):
            # A drop of more than the whole penalty ends any rise, so its size doesn't matter.
            lead = np.cumsum(np.maximum(scores[j] - own, -2 * SWITCH_PENALTY))
            before = np.concatenate([[0.0], lead[:-1]])
            base = before[first[full]][np.searchsorted(full, w.text)]
            low = np.minimum.accumulate(before - base + floor)
            rise = np.maximum.reduceat(lead - base + floor - low, first[full])
            best[full[rise > SWITCH_PENALTY / 2]] = -1
        return best


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
_LABEL_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])
LABEL_SCHEMA = "lang_pred string, score double, spans array<struct<lang: string, first_word: int, n_words: int>>"


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each column of ``scores``, where each change of label
    between neighbours costs ``penalty``."""
    n_lang, n = scores.shape
    rows, best = scores.T.tolist(), scores[:, 0].tolist()
    back: list[list[int]] = []
    for row in rows[1:]:
        top = max(best)
        come, limit = best.index(top), top - penalty
        back.append([k if best[k] >= limit else come for k in range(n_lang)])
        best = [max(best[k], limit) + row[k] for k in range(n_lang)]
    path = np.empty(n, np.int64)
    path[-1] = best.index(max(best))
    for t in range(n - 2, -1, -1):
        path[t] = back[t][path[t + 1]]
    return path


def fit(labelled: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """A model of the languages in ``labelled`` (doc_id, text, lang), fitted on
    about ``train_documents`` of each, picked by a hash of the id.  Rows with a
    null text or lang are not used."""
    rows = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg((train_documents / F.count("*")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.join(F.broadcast(sizes), "lang").filter(chance < F.col("share")).select("text", "lang")
    n_cells = BUCKETS + len(_NAMES)

    def counted(batches):
        """Counts of buckets and scripts, only those that occur."""
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                w = _words(texts)
                counts = np.bincount(np.append(w.buckets, BUCKETS + w.letter_script), minlength=n_cells)
                cells = np.flatnonzero(counts)
                columns = [pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "cell", "n"])

    # At most n_cells rows a language come to the driver.
    added = picked.mapInArrow(counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().sort_by("lang")
    names, cell, n_of = added.column("lang").to_numpy(), added.column("cell").to_numpy(), added.column("n").to_numpy()
    languages = sorted(set(names.tolist()))
    all_grams = np.zeros(BUCKETS)
    np.add.at(all_grams, cell[cell < BUCKETS], n_of[cell < BUCKETS])
    weight = BACKGROUND * all_grams / max(all_grams.sum(), 1) + 0.05  # towards all languages' letters
    total, seen = np.zeros(len(languages)), []
    uses = np.zeros((len(languages), len(_NAMES)), bool)
    for k, lang in enumerate(languages):
        order = np.flatnonzero(names == lang)
        order = order[np.argsort(cell[order])]
        cells, n = cell[order], n_of[order]
        gram = cells < BUCKETS
        whole = weight.sum() + n[gram].sum()
        total[k] = np.log(whole)
        seen.append((cells[gram].astype(np.uint16), np.log((n[gram] + weight[cells[gram]]) / whole).astype(np.float32)))
        scripts = np.zeros(len(_NAMES))
        scripts[cells[~gram] - BUCKETS] = n[~gram]
        uses[k] = scripts >= SCRIPT_SHARE * max(scripts.sum(), 1)
    return LanguageModel(languages, np.log(weight), total, seen, uses)


def label_column(spark, model: LanguageModel, text: Column) -> Column:
    """``model``'s labels of ``text`` as a struct column, see ``LanguageModel.label``.

    Null texts and texts without a letter are ``und`` with score 0 and no spans.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded by BUCKETS for each language
    at_once = LABEL_BYTES * LABEL_LANGUAGES // max(LABEL_LANGUAGES, len(model.languages))

    @F.arrow_udf(LABEL_SCHEMA)
    def label(texts: pa.Array) -> pa.Array:
        values, parts, at = texts.to_pylist(), [], 0
        while at < len(values):  # a few hundred KB at once keep the arrays small
            end, size = at, 0
            while end < len(values) and (size < at_once or end == at):
                size += len(values[end] or "")
                end += 1
            parts.append(shared.value.label(values[at:end]))
            at = end
        return pa.concat_arrays(parts) if parts else pa.array([], _LABEL_TYPE)

    return label(text)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame) -> LanguageModel:
    """The model of the documents that are not held out; rows without doc_id aren't learned from."""
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of each row of ``docs``
    (doc_id, text).  Null and empty texts are ``und`` with score 0; equal texts,
    repeated rows too, get equal labels; of languages tied in letters the more
    likely wins, then the first by name; an empty table gives an empty result;
    other columns, whatever their names, are left out.  A text is labelled
    whole, which takes 8 bytes a word and language, so very long texts may have
    some 10 million words with ten languages."""
    labels = docs.select("doc_id", held_out().alias("held_out"), label_column(docs.sparkSession, model, F.col("text")).alias("label"))
    return labels.select("doc_id", "held_out", "label.lang_pred", "label.score", "label.spans")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_languages(docs, train(docs)).drop("spans")
