"""Collects the query modules: each has QUERIES (name -> function) and ORACLES (name -> SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query modules of this library, one for each operator family.
MODULES: tuple[str, ...] = ("corpus", "relational", "evaluation", "spans", "lexicon", "matching", "rules", "review")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"lexiforge.plans.{name}"), attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"defined twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict[str, Callable]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
