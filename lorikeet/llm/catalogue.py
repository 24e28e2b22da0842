"""Queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from lorikeet.llm import p2, p3, p4, p5, p6, p7, p8, p9, p10

_MODULES = (p2, p3, p4, p5, p6, p7, p8, p9, p10)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
