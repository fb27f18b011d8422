"""Registered queries and their SQL."""

from __future__ import annotations

from . import flows, links, texts

_PARTS = (links, texts, flows)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
