"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["language_id", "minhash", "substring", "mixing", "decontaminate", "topk", "warc_zip", "html_paths", "pii", "url_filter", "fim", "simhash", "conversations"]


def _modules():
    return [importlib.import_module(f"foliant.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
