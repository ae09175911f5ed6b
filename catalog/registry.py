"""All registered queries."""

from __future__ import annotations

from catalog import collection, series, signals, storing

PARTS = (collection, series, signals, storing)


def queries() -> dict:
    return {name: fn for part in PARTS for name, fn in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.ORACLE.items()}
