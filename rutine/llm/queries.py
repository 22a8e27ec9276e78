"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Module of each operator, by its number.
MODULES = {1: "ngram_join", 2: "suffix_dedup", 3: "langid", 4: "bpe_queries", 5: "mixing", 6: "blocknames", 7: "warc", 8: "substring", 9: "secrets", 10: "topk", 11: "turn_trie", 12: "line_dedup", 13: "spelling"}


def _all() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for n, name in MODULES.items():
        module = importlib.import_module(f"rutine.llm.{name}")
        queries |= {k: f for k, f in vars(module).items() if k.startswith(f"op{n}_") and callable(f)}
        sql |= getattr(module, "ORACLE", {})
    return queries, sql


def queries() -> dict:
    return _all()[0]


def oracle_sql() -> dict:
    return _all()[1]
