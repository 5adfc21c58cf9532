"""What several plans share: rounding and the SQL of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Six places, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def registry():
    """(queries, SQL, decorator): the decorator enters a query, with its SQL if it has any."""
    queries, sql = {}, {}

    def query(text: str | None = None):
        def enter(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return enter

    return queries, sql, query


NOW_MS = 1706745600000


def turns_sql(session: str = "conv_id") -> str:
    return (
        f"turns AS (SELECT {session} AS session_id, lpad(conv_id::VARCHAR, 8, '0') || ':' || lpad(turn::VARCHAR, 4, '0') AS id, text, role, "
        "1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms, conv_id % 20 AS user_ns FROM conversations)"
    )


VECTORS_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, 'label:' || label AS collection FROM embeddings)"
