"""Where queries and their SQL are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The class SPACE as DuckDB writes it.
PY_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def excerpt_sql(at: str, length: str, radius: int = 140) -> str:
    """SQL of what evidence.excerpt shows of text around a span; at counts from 0."""
    begin = f"greatest(0, {at} - {radius})"
    return f"regexp_replace(regexp_replace(substr(text, CAST({begin} + 1 AS BIGINT), CAST({at} + {length} + {radius} - {begin} AS BIGINT)), '{PY_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
