"""All queries outside the optional subpackage, with their SQL."""

from __future__ import annotations

from lorikeet.plans import p1, reference, stored

_MODULES = (reference, stored, p1)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
