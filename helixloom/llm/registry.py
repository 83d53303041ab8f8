"""The queries of the corpus operators, by name."""

from __future__ import annotations

import importlib

MODULES = ("language_id", "exact_dedup", "quality", "warc", "packing", "line_dedup", "passage_dedup", "toxicity", "decontamination", "secrets", "simhash", "personal", "collocations", "spelling")


def _modules():
    return [importlib.import_module(f"helixloom.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
