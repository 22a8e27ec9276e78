"""Registered queries of the library."""

from __future__ import annotations

from rutine.registry import QUERIES, SQL

#: The most frequent pairs of each log: source, order, symbols, windows and aggregation in one.
FLAGSHIP = "q_bigram_top"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
