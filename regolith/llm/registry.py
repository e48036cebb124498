"""All queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["exact_dedup", "language_id", "decontaminate", "toxicity", "license_scan", "url_filter", "mixing", "ngram_join", "chat_format", "token_store", "hard_negatives", "alignment", "near_dedup"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"regolith.llm.{name}").QUERIES
    return found | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"regolith.llm.{name}").SQL
    sql = importlib.import_module("corpus_pipeline").ORACLE_SQL
    return found | ({"pipeline": sql} if sql else {})
