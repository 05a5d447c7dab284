"""All sections of registered queries."""

from __future__ import annotations

from . import aggregations, extras, filters, graphs, joins, motion, scalars, sources, windows
from .registry import Query

SECTIONS = (filters, joins, aggregations, scalars, windows, graphs, motion, sources, extras)


def queries() -> dict[str, Query]:
    return {k: f for m in SECTIONS for k, f in m.section.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in SECTIONS for k, s in m.section.sql.items()}
