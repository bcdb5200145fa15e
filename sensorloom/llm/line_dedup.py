"""Removal of lines whose template recurs across documents.

A tree of fixed depth parses each line: by its number of tokens, then by its
leading tokens, where tokens with a digit count as variable.  In each leaf a
token stays in the template if enough lines have it at its place; other fields
are generalised to a wildcard.  A template with enough constant tokens that is
in enough documents is recurring: its lines are dropped but in the document
with the smallest id.  Everything is DataFrame functions.

Lines are handled as hashes of their leaf and content.  Only one line of each
content in a leaf that enough documents have is looked at token by token, so a
line that is in a third of all documents is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Leading tokens of a leaf; documents that make a token constant and a template recurring; least share of constant tokens;
#: share of the line's median support below which a token is a field's value.
DEPTH = 3
MIN_DOCUMENTS = 5
MIN_CONSTANT = 0.75
FIELD_SHARE = 0.5

WILDCARD = "<*>"
_SPACE = r" \t\x0B\f\r"
_KEY = ["doc_id", "text_hash"]


def _masked(line: Column) -> Column:
    """``line`` with a wildcard for each token that has a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"[^{_SPACE}]*[0-9][^{_SPACE}]*", WILDCARD)).otherwise(line)


def _tokens(masked: Column) -> Column:
    return F.filter(F.split(masked, f"[{_SPACE}]+"), lambda x: x != "")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows that take part; rows of one doc_id and different texts are told apart."""
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def hashed_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_hash, line, leaf, content) of each line with a token; the last two are 64-bit hashes."""
    lines = _keyed(docs).select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    lines = lines.filter(F.col("content").rlike(f"[^{_SPACE}]"))  # has a token; a filter on the tokens would make them twice
    lines = lines.select(*_KEY, "line", _masked(F.col("content")).alias("masked")).withColumn("tokens", _tokens(F.col("masked")))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    return lines.select(*_KEY, "line", leaf.alias("leaf"), F.xxhash64("masked").alias("content"))


def recurring_contents(docs: DataFrame, lines: DataFrame, min_documents: int = MIN_DOCUMENTS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """(leaf, content, first_doc): line contents whose template recurs, and the document that keeps it."""
    pairs = lines.select("leaf", "content", "doc_id").distinct()
    place = F.struct("doc_id", "text_hash", "line")
    contents = lines.groupBy("leaf", "content").agg(F.min(place).alias("at"))
    weights = pairs.groupBy("leaf", "content").agg(F.count("*").alias("weight"))
    common = weights.groupBy("leaf").agg(F.sum("weight").alias("n")).filter(F.col("n") >= min_documents).select("leaf")
    contents = C.stored(contents.join(weights, ["leaf", "content"]).join(common, "leaf", "left_semi"), "line-contents")

    wanted = contents.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct("at.line", "leaf", "content", "weight")).alias("wanted")
    )
    found = _keyed(docs).dropDuplicates(_KEY).join(wanted, _KEY).select(F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w"))
    parsed = found.select("w.leaf", "w.content", "w.weight", _tokens(_masked(F.get("lines", F.col("w.line")))).alias("tokens"))
    places = C.stored(
        parsed.select("leaf", "content", "weight", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("place", "token"))
        .filter(F.col("token") != WILDCARD)
        .select("leaf", "content", "weight", "n_tokens", "place", F.xxhash64("token").alias("token")),
        "line-places",
    )
    supported = places.groupBy("leaf", "place", "token").agg(F.sum("weight").alias("n")).filter(F.col("n") >= min_documents)
    parts = (
        places.join(supported, ["leaf", "place", "token"])
        .groupBy("leaf", "content", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("place", "token", "n"))).alias("fine"))
        .filter(F.size("fine") >= min_constant * F.col("n_tokens"))
    )
    # The second form follows from the first, so it only ever merges templates.
    median = F.element_at(F.array_sort(F.col("fine.n")), F.ceil(F.size("fine") / 2).cast("int"))
    parts = parts.withColumn("least", FIELD_SHARE * median).withColumn("coarse", F.filter("fine", lambda x: x["n"] >= F.col("least")))
    template = F.when(F.size("coarse") >= min_constant * F.col("n_tokens"), F.xxhash64("coarse")).otherwise(F.xxhash64("fine"))
    templates = parts.select("leaf", "content", template.alias("template"))
    templates = C.checkpointed(templates)
    documents = pairs.join(templates, ["leaf", "content"]).select("leaf", "template", "doc_id").distinct()
    recurring = documents.groupBy("leaf", "template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return templates.join(recurring.filter(F.col("n") >= min_documents), ["leaf", "template"]).select("leaf", "content", "first_doc")


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_documents: int = MIN_DOCUMENTS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """``docs``, all columns, with ``text`` less the dropped lines, and a struct
    column ``line_dedup`` (n_lines, n_dropped), which replaces one of that name.

    ``docs`` needs doc_id and text; lines end with \\n.  A token is constant if
    ``min_documents`` pairs of a document and a line have it at its place, and,
    where enough constants are left, at least half as many as have the line's
    median constant.  Rows of one doc_id are one document.  A null text stays null with 0 lines; lines
    without a token have no template and stay; rows with a null doc_id take no
    part and keep all lines; a document whose lines are all dropped keeps an
    empty text.
    """
    lines = C.stored(hashed_lines(docs, depth), "lines")
    recurring = recurring_contents(docs, lines, min_documents, min_constant)
    dropped = lines.join(recurring, ["leaf", "content"]).filter("doc_id <> first_doc")
    gone = dropped.groupBy(*_KEY).agg(F.sort_array(F.collect_set("line")).alias("gone"))

    # Rows as structs, so that no column name of theirs can clash.
    names = [c for c in docs.columns if c != "line_dedup"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).join(gone, _KEY, "left")
    own = {c: F.col("row").getField(c) for c in names}

    # The runs of lines between the dropped ones, so that no line is looked up in a set.
    text_lines = F.split(own["text"], "\n", -1)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.element_at("gone", i))
    after = lambda i: F.when(i == F.size("gone"), F.size(text_lines)).otherwise(F.element_at("gone", i + 1))
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice(text_lines, before(i) + 2, after(i) - before(i) - 1))
    text = F.when(F.col("gone").isNull(), own["text"]).otherwise(F.array_join(F.flatten(runs), "\n"))
    counts = F.struct(
        F.when(own["text"].isNull(), 0).otherwise(F.size(text_lines)).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped")
    )
    return rows.select(*[(text if c == "text" else own[c]).alias(c) for c in names], counts.alias("line_dedup"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = drop_recurring_lines(docs.select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("line_dedup.n_lines").cast("long").alias("n_lines"),
        F.col("line_dedup.n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS content
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), parsed AS (
  SELECT doc_id, line, masked, list_filter(regexp_split_to_array(masked, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS tokens
  FROM (SELECT doc_id, line, regexp_replace(content, '[^ \t\x0B\f\r]*[0-9][^ \t\x0B\f\r]*', '<*>', 'g') AS masked FROM lines)
), leaves AS (
  SELECT doc_id, line, masked, tokens, len(tokens) AS n_tokens, list_slice(tokens, 1, 3) AS lead FROM parsed WHERE len(tokens) > 0
), common AS (
  SELECT n_tokens, lead FROM leaves GROUP BY ALL HAVING count(DISTINCT (doc_id, masked)) >= 5
), places AS (
  SELECT doc_id, line, masked, n_tokens, lead, unnest(range(0, len(tokens))) AS place, unnest(tokens) AS token
  FROM leaves SEMI JOIN common USING (n_tokens, lead)
), supported AS (
  SELECT n_tokens, lead, place, token, count(DISTINCT (doc_id, masked)) AS n FROM places WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT (doc_id, masked)) >= 5
), fine AS (
  SELECT doc_id, line, n_tokens, lead, list({'p': place, 't': token, 'n': n} ORDER BY place) AS fine, list_sort(list(n))[(count(*) + 1) // 2] AS median
  FROM places JOIN supported USING (n_tokens, lead, place, token) GROUP BY doc_id, line, n_tokens, lead HAVING count(*) >= 0.75 * n_tokens
), coarse AS (
  SELECT *, list_filter(fine, lambda x: x.n >= 0.5 * median) AS coarse FROM fine
), templates AS (
  SELECT doc_id, line, n_tokens, lead, CASE WHEN len(coarse) >= 0.75 * n_tokens THEN coarse ELSE fine END AS template FROM coarse
), recurring AS (
  SELECT n_tokens, lead, template, min(doc_id) AS first_doc FROM templates GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5
), gone AS (
  SELECT doc_id, line FROM templates JOIN recurring USING (n_tokens, lead, template) WHERE doc_id <> first_doc GROUP BY ALL
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped,
         coalesce(string_agg(l.content, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept
"""
