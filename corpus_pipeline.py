"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicate
removal, benchmark decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the
last with the columns of ``docs``.  What a stage rejects does not reach the
next one.  Columns of any name come through unchanged, but ``text`` and
``n_chars`` where lines were dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import common, decontamination, jaccard_join, language_id, line_dedup, piece_encoding

#: A document stays if at least this share of its letters is in spans of its main language.
MIN_LANGUAGE_SHARE = 0.35


def _rows(docs: DataFrame) -> Column:
    """Whole rows as structs, so that no column name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a main language; those without a letter, null and
    empty texts too, and those in no language mostly go.  Repeated rows and ties
    are judged alike; an empty table stays empty; a very long text is labelled
    whole, see ``language_id.identify_languages``."""
    label = language_id.label_column(spark, language_id.train(docs), F.col("text"))
    labelled = docs.select(_rows(docs), label.alias("label"))
    return labelled.filter((F.col("label.lang_pred") != language_id.UNDETERMINED) & (F.col("label.score") >= MIN_LANGUAGE_SHARE)).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, and documents that have nothing else; n_chars
    follows the text.  Null texts, documents without lost lines and rows without
    doc_id stay as they are; repeated rows lose the same lines; an empty table
    stays empty; a very long text is split into its lines, no more."""
    kept = line_dedup.drop_recurring_lines(docs.select("doc_id", "text", _rows(docs)))
    touched = F.col("line_dedup.n_dropped") > 0
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [F.when(touched, changed.get(c, F.col("row").getField(c))).otherwise(F.col("row").getField(c)).alias(c) for c in docs.columns]
    return kept.filter(~touched | (F.trim("text") != "")).select(columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group.  Texts without
    words are groups of their own; of rows equal in doc_id and text one stays;
    rows without doc_id stay; an empty table stays empty; for very long texts
    see ``jaccard_join.jaccard_components``."""
    return jaccard_join.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``.  Null texts stay;
    repeated rows are judged alike; an empty table on either side drops nothing;
    a very long text is read whole."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document that is left, a row each, repeated rows
    too; a null or empty text has none; an empty table gives an empty result;
    for ties and very long texts see ``piece_encoding.encode_documents``."""
    return piece_encoding.encode_documents(docs, piece_encoding.load_vocabulary())


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("piece_encoding", encode),
]

#: Scores, a classifier and edit distances are not SQL's; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
