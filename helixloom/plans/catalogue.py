"""The catalogue of registered queries: a name, its DataFrame form and its SQL oracle."""

from __future__ import annotations

from helixloom.plans import alignment, annotation, assembly, assoc, explorer, formats, phylo, qc, streams, tables, views

MODULES = (qc, assoc, explorer, alignment, assembly, phylo, annotation, tables, streams, views, formats)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
