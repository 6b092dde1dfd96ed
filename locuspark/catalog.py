"""The registered queries of the core library and their SQL."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "base_counts"
MODULES = ["loci_queries", "value_queries", "extra_queries", "more_queries"]


def _gather(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"locuspark.plans.{m}"), what).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
