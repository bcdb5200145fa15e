"""The queries by name, and their SQL; the plan modules add theirs on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SAMPLES_SQL = """WITH s AS (
  SELECT user_id, event_id, event_type, value, epoch_us(ts) AS ts_us, CAST(floor(value * 8) AS BIGINT) AS raw,
         CAST(floor(value * 400) AS BIGINT) AS red, CAST(floor(value * 600) AS BIGINT) AS ir, 200 + value * 4 AS rr_ms,
         event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events
)"""

#: Beginnings that several queries' SQL has in common.
FRAGMENTS = {"$S": SAMPLES_SQL, "$R": SAMPLES_SQL.replace("WITH s AS", "WITH RECURSIVE s AS")}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL with the fragments put in."""

    def register(f):
        QUERIES[name] = f
        if sql:
            text = sql
            for mark, fragment in FRAGMENTS.items():
                text = text.replace(mark, fragment)
            SQL[name] = text
        return f

    return register
