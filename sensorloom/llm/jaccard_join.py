"""Components of documents whose word shingles overlap, by an exact set join.

A document's set is represented by its signature, so equal sets are one node
with one set.  Sets are ordered by how common their shingles are, and two sets
that overlap enough share a shingle in their prefixes, which are the index.
Its lists are used twice:

* Each set is compared with one leader of its lists; what that links is joined
  into components, so a group of thousands of near copies takes about as many
  comparisons as it has members.
* Within each list the postings of a component are a block.  Blocks of the own
  component are skipped as their answer is known, others where their sizes
  and positions can't reach the threshold; lists meet by bands of sizes, so
  sets of sizes that a position excludes never meet.  Pairs from different
  components that are left are answered from their leaders' overlap and the
  few shingles in which they differ from their leaders.

So every pair that is never compared is in one component already, or proven to
be below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE_WORDS = 5
PERCENT = 80
BYTES_PER_WORD = 6

_POWERS = C.Powers(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xD6E8FEB86659FD93)

SET_SCHEMA = "doc_id long, n_shingles long, signature binary, prefix array<struct<token: long, pos: int>>, shared array<long>"


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle), sorted and distinct: the sets of some texts as 64-bit hashes."""
    words = C.Words(texts, lower=True)
    sizes, (hashed,) = words.sizes, words.hashes
    ends = np.cumsum(sizes)
    starts = np.flatnonzero(np.arange(len(hashed)) <= np.repeat(ends - width, sizes))
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))
    shingle = C.mixed(C.window_sums(hashed, width, _POWERS)[starts])
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(few):
        whole = [xxhash.xxh64_intdigest(hashed[ends[i] - sizes[i] : ends[i]].tobytes()) for i in few]
        doc, shingle = np.append(doc, few), np.append(shingle, C.mixed(np.array(whole, np.uint64) ^ _SHORT))
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[new], shingle[new]


def _distinct_sets(table: pa.Table, width: int) -> tuple[np.ndarray, list[bytes | None], list[tuple[int, np.ndarray]]]:
    """Sizes and signatures of a chunk's documents, and the first document of each signature with its set."""
    doc, shingle = _sets(C.texts_of(table), width)
    edges = np.searchsorted(doc, np.arange(table.num_rows + 1))
    signatures: list[bytes | None] = []
    first: dict[bytes, tuple[int, np.ndarray]] = {}
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        signature = xxhash.xxh3_128_digest(shingle[a:b].tobytes()) if b > a else None
        signatures.append(signature)
        if signature is not None:
            first.setdefault(signature, (i, shingle[a:b]))
    return np.diff(edges), signatures, list(first.values())


def indexed_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each document: its set's size and signature; on one row of each
    signature and chunk whose set may overlap another, the prefix's shingles
    that may be elsewhere too with their positions, and all such shingles."""
    n_bytes = C.text_bytes(docs)
    sketch = C.Sketch(n_bytes / BYTES_PER_WORD, C.counted)
    chunks = C.chunked(docs, C.chunk_count(n_bytes))
    by_chunk = chunks.groupBy("chunk")

    def sketched(key: tuple, table: pa.Table) -> pa.Table:
        _, _, first = _distinct_sets(table, width)
        return sketch.part(key[0].as_py(), np.concatenate([np.zeros(0, np.uint64), *[x for _, x in first]]))

    def index(table: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, signatures, first = _distinct_sets(table, width)
        values = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in first]])
        _, _, of = sketch.touched(values)
        answer = C.answers_of(answers)
        counts = answer[of].min(0) if of.size else answer
        prefix: list = [None] * table.num_rows
        shared: list = [None] * table.num_rows
        at = 0
        for i, tokens in first:
            n = len(tokens)
            c = counts[at : at + n]
            at += n
            order = np.lexsort((tokens, c))[: n - (percent * n + 99) // 100 + 1]
            pos = np.flatnonzero(c[order] > 1)
            if len(pos):
                found = tokens[order[pos]].view(np.int64)
                prefix[i] = [{"token": t, "pos": p} for t, p in zip(found.tolist(), pos.tolist(), strict=True)]
                shared[i] = tokens[c > 1].view(np.int64)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_shingles": pa.array(sizes.astype(np.int64)),
                "signature": pa.array(signatures, pa.binary()),
                "prefix": pa.array(prefix, pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))),
                "shared": pa.array(shared, pa.list_(pa.int64())),
            }
        )

    counts = sketch.exchange.answered(by_chunk.applyInArrow(sketched, C.PART_SCHEMA))
    counts = counts.select(F.col("sender").alias("chunk"), "dest", "n", "a")
    return by_chunk.cogroup(counts.groupBy("chunk")).applyInArrow(index, SET_SCHEMA)


def _reaches(overlap: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether ``overlap`` shared elements are enough for sets of these sizes."""
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with their sets' sizes and overlap."""
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("shared").alias("shared_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("shared").alias("shared_b"))
    overlap = F.size(F.array_intersect("shared_a", "shared_b")).alias("overlap")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", overlap)


def _leader_links(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a: leader, b, size_a, size_b, overlap) of each set with the leader
    that most of its lists have.  A list's leader is its set with the fewest
    shingles of its own: an original has none, each of its edited copies some."""
    central = F.struct("n_unique", F.xxhash64("node"))
    leader = postings.groupBy("token").agg(F.min_by(F.struct("node", "size", "pos"), central).alias("leader"), F.count("*").alias("n"))
    lists = postings.join(leader.filter("n > 1"), "token").filter(F.col("node") != F.col("leader.node"))
    rest = F.least(F.col("size") - F.col("pos"), F.col("leader.size") - F.col("leader.pos"))
    near = lists.filter(_reaches(rest, F.col("size"), F.col("leader.size"), percent))
    votes = near.groupBy(F.col("leader.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("votes"))
    pairs = votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a"))
    found = _overlaps(pairs.select("a", "b"), sets, percent)
    return found.filter(_reaches(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent))


def _most_size(size: Column, pos: Column, percent: int) -> Column:
    """The size up to which another set can be similar to one of ``size`` that shares nothing before ``pos``."""
    return F.floor((100 + percent) * (size - pos) / percent).cast("int") - size


def _band(size: Column) -> Column:
    """Sizes in bands of a fifth of a doubling or less."""
    return F.floor(5 * F.log2(size.cast("double"))).cast("int")


def _opened(own: DataFrame, percent: int) -> DataFrame:
    """Postings (a, size, pos) with the blocks (token, band, other) of no larger sets that they may hold an answer to.

    A posting at ``pos`` of a set can only meet sets up to a size that falls with
    ``pos``, and of two sets the larger looks the smaller up, so it goes to a few
    bands of sizes of its list, or to none; a set is only looked up at positions
    within a ninth of its size (at 80 hundredths).  Lists meet their blocks by
    (token, band), never as a whole."""
    size, pos = F.col("size"), F.col("pos")
    filed = own.withColumn("most", _most_size(size, pos, percent)).filter(F.col("most") >= size).withColumn("band", _band(size))
    blocks = filed.groupBy("token", "band", F.col("component").alias("other")).agg(F.min("pos").alias("min_pos"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.max("most").alias("most"))
    least, top = F.ceil(size * percent / 100).cast("int"), F.least(size, _most_size(size, pos, percent))
    asking = own.withColumn("least", least).withColumn("top", top).filter("least <= top")
    asking = asking.withColumn("band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("top")))))
    met = asking.join(blocks, ["token", "band"])
    # A block is skipped if even its best sizes and position can't reach the threshold.
    best = F.least(F.col("max_size") - F.col("min_pos"), size - pos)
    fits = (F.col("component") != F.col("other")) & (F.col("min_size") <= F.col("top")) & (F.col("max_size") >= F.col("least")) & (F.col("most") >= size)
    met = met.filter(fits & _reaches(best, size, F.col("min_size"), percent))
    return met.select("token", "band", "other", F.col("node").alias("a"), "size", "pos")


def _left_pairs(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from different components that some list leaves possible."""
    own = postings.join(labels.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    own = C.checkpointed(own.join(several, "token", "left_semi").select("token", "node", "size", "pos", "component"))
    other = own.select("token", _band(F.col("size")).alias("band"), F.col("component").alias("other"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"))
    rest = F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b"))
    pairs = _opened(own, percent).join(other, ["token", "band", "other"]).filter((F.col("size_b") <= F.col("size")) & _reaches(rest, F.col("size"), F.col("size_b"), percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _answers(pairs: DataFrame, leaders: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs``, derived from their leaders' overlap.

    A set is its leader's with some shingles more (plus) and some less (minus).
    So the overlap of a and b is that of their leaders, and of each one's plus and
    minus with the other's leader, and of the plus and minus with each other,
    minus counting negative.  Leaders' sets travel once for each leader or set
    that they are asked by; a pair takes the few differing shingles only.
    """
    of = lambda x: leaders.select(F.col("node").alias(x), F.col("leader").alias(f"lead_{x}"), F.col("apart").alias(f"apart_{x}"), F.col("size").alias(f"size_{x}"))
    led = C.checkpointed(pairs.join(of("a"), "a").join(of("b"), "b"))
    known = _overlaps(led.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b")).distinct(), sets, percent)
    known = known.select(F.col("a").alias("lead_a"), F.col("b").alias("lead_b"), "overlap")
    most = F.col("overlap") + F.col("apart_a") + F.col("apart_b")
    possible = C.checkpointed(led.join(known, ["lead_a", "lead_b"]).filter(_reaches(most, F.col("size_a"), F.col("size_b"), percent)))

    asked = possible.select(F.col("a").alias("node"), F.col("lead_a").alias("lead"), F.col("lead_b").alias("with"))
    asked = asked.unionByName(possible.select(F.col("b").alias("node"), F.col("lead_b").alias("lead"), F.col("lead_a").alias("with"))).distinct()
    shared = lambda x, name: sets.select(F.col("node").alias(x), F.col("shared").alias(name))
    differing = asked.filter("node <> lead").select("node", "lead").distinct().join(shared("node", "own"), "node").join(shared("lead", "led"), "lead")
    differing = C.checkpointed(differing.select("node", F.array_except("own", "led").alias("plus"), F.array_except("led", "own").alias("minus")))
    both = lambda x, y: F.size(F.array_intersect(x, y))
    half = asked.select("node", "with").join(differing, "node").join(shared("with", "led"), "with").select("node", "with", (both("plus", "led") - both("minus", "led")).alias("change"))
    change = lambda x, y: half.select(F.col("node").alias(x), F.col("with").alias(f"lead_{y}"), F.col("change").alias(f"change_{x}"))
    few = lambda x: differing.select(F.col("node").alias(x), F.col("plus").alias(f"plus_{x}"), F.col("minus").alias(f"minus_{x}"))
    full = possible.join(change("a", "b"), ["a", "lead_b"], "left").join(change("b", "a"), ["b", "lead_a"], "left").join(few("a"), "a", "left").join(few("b"), "b", "left")
    cross = both("plus_a", "plus_b") + both("minus_a", "minus_b") - both("plus_a", "minus_b") - both("minus_a", "plus_b")
    zero = F.lit(0)
    overlap = F.col("overlap") + F.coalesce("change_a", zero) + F.coalesce("change_b", zero) + F.when(F.col("plus_a").isNull() | F.col("plus_b").isNull(), 0).otherwise(cross)
    return full.filter(_reaches(overlap, F.col("size_a"), F.col("size_b"), percent)).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The component of each document, linking sets whose Jaccard similarity is
    ``percent`` hundredths or more.

    ``docs`` needs doc_id and text.  A set holds the distinct shingles of
    ``width`` words of the text in ASCII lower case; a text with fewer words is
    one shingle.  Returns a row for each row of ``docs``: doc_id, n_shingles,
    component_id (the smallest doc_id that links reach, the row's own
    included).  Null texts and texts without words have empty sets and stay by
    themselves; equal sets are linked; a null doc_id is never the smallest; an
    empty table gives an empty result; other columns are left out.  Repeated
    rows are rows each, with one set; rows of one doc_id and different texts
    are linked by their texts alone.  A similarity of just ``percent``
    hundredths links; ties among leaders go by a hash and change no component.
    A text is one task's work, however long: about sixty bytes a word there, and
    its set as one array of 8 bytes a shingle that others may have too.
    """
    rows = C.stored(indexed_sets(docs, width, percent), "shingle-sets")
    found = rows.filter("shared IS NOT NULL").select(F.col("signature").alias("node"), F.col("n_shingles").cast("int").alias("size"), "prefix", "shared")
    n_unique = (F.col("size") - F.size("shared")).alias("n_unique")
    postings = found.select("node", "size", n_unique, F.explode("prefix").alias("p")).select("p.token", "node", "size", "n_unique", "p.pos")
    postings = C.checkpointed(postings.groupBy("token", "node", "size", "pos").agg(F.min("n_unique").alias("n_unique")))
    sets = C.stored(found.groupBy("node", "size").agg(F.first("shared").alias("shared")), "shared-shingles")

    near = C.checkpointed(_leader_links(postings, sets, percent))
    labels = C.checkpointed(components(near.select("a", "b")))
    # Each set's leader, itself if it has none, and how many of its shingles the leader lacks.
    led = near.select(F.col("b").alias("node"), F.col("a").alias("leader"), (F.col("size_b") - F.col("overlap")).alias("apart"))
    sizes = postings.select("node", "size").distinct()
    leaders = sizes.join(led, "node", "left").select("node", "size", F.coalesce("leader", "node").alias("leader"), F.coalesce("apart", F.lit(0)).alias("apart"))
    more = _answers(_left_pairs(postings, labels, percent), leaders, sets, percent)

    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    between = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(between.distinct()).select(F.col("node").alias("component"), F.col("component").alias("larger"))
    labels = labels.unionByName(labels.select(F.col("component").alias("node"), "component")).unionByName(
        joined.select(F.col("component").alias("node"), "component")
    )
    labels = labels.groupBy("node").agg(F.min("component").alias("component")).join(joined, "component", "left")
    labels = C.checkpointed(labels.select("node", F.coalesce("larger", "component").alias("component")))

    of_doc = rows.select("doc_id", "n_shingles", F.col("signature").alias("node")).join(labels, "node", "left")
    of_doc = of_doc.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    # Kept apart from the join, so that a component with very many documents can be split there.
    smallest = C.checkpointed(of_doc.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return of_doc.join(smallest, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with only the smallest doc_id of each component;
    of rows equal in doc_id and text one stays, and rows without doc_id stay."""
    groups = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
