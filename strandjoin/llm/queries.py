"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("licenses", "tokens", "neardup", "secrets", "packing", "language", "decontaminate", "neighbours", "sharding", "substrings")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(importlib.import_module(f"{__package__}.{module}"), name))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
