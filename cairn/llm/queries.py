"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from importlib import import_module

#: Query name and module; a module's ORACLE is its SQL.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_topk": "topk",
    "op3_langid": "langid",
    "op4_quality": "quality",
    "op5_token_counts": "token_counts",
    "op6_simhash_dedup": "simhash",
    "op7_bpe": "bpe",
    "op8_decontaminate": "decontaminate",
    "op9_ppm": "ppm",
    "op10_suffix_dedup": "suffix_dedup",
    "op11_pii": "pii",
    "op12_conversations": "conversations",
    "op13_alignment": "alignment",
}


def queries() -> dict:
    return {name: getattr(import_module(f"cairn.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"cairn.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
