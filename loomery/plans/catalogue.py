"""All registered queries of the library, without those of the corpus operators."""

from __future__ import annotations

from loomery.plans import decisions, governance, learning, online, searching, series, tabular, texts

MODULES = (tabular, governance, decisions, series, texts, online, learning, searching)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
