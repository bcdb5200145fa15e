import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; tables may have columns of these names.
CLASHING = ["chunk", "shard", "counts", "cells", "kind", "tokens", "n_tokens", "n_removed", "node", "label", "text_hash", "line", "leaf", "content", "gone", "row", "score", "component", "signature", "_label"]


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "und", "le", "the", "zeta"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): copies, near copies, shared passages, ties, nulls, empties, one long text."""
    rng = random.Random(7)
    base, passage = words(rng, 300), words(rng, 60)
    rows = [(10, " ".join(base)), (11, " ".join(base)), (12, "  ".join(base).upper())]
    for i in range(20, 60):
        near = list(base)
        for _ in range(rng.randrange(1, 14)):
            near[rng.randrange(300)] = "x" + str(rng.randrange(10**6))
        rows.append((i, " ".join(near)))
    for i in range(100, 130):
        own = words(rng, rng.randrange(3, 120))
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage * (i % 2) + own[at:]) + "\n" * (i % 3) + "é日本🙂" * (i % 2)))
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "one"), (205, "One two"), (206, "a b c d e"), (207, "a b c d e f")]
    rows += [(208, "z" * 49), (209, "z" * 50), (210, "z" * 51), (211, "y" * 5000), (212, " ".join(["w"] * 400)), (10, " ".join(base)), (10, "again under one id")]
    rows += [(None, " ".join(base)), (None, None), (300, " ".join(words(rng, 30000)))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    docs = spark.createDataFrame(edge_rows, "doc_id long, text string").repartition(3)
    return docs.select("doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
