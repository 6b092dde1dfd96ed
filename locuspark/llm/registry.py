"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["langid", "minhash", "mixing", "pieces", "secret_scan", "sharding", "token_counts", "tokenbin", "topk", "vectors"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"locuspark.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"locuspark.llm.{m}").ORACLES.items()}
