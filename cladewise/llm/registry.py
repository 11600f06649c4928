"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("language_id", "toxicity", "substring_dedup", "exact_dedup", "minhash_dedup", "quality", "decontamination", "mixing", "sharding", "token_counts")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
