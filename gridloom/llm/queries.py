"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: name: (module, function, name of its SQL or None)
REGISTRY = {
    "op1_suffix_dedup": ("suffix_dedup", "op1_suffix_dedup", "OP1_SQL"),
    "op2_pitman_yor": ("pitman_yor", "op2_pitman_yor", None),
    "op3_decontamination": ("decontamination", "op3_decontamination", None),
    "op4_pii": ("pii", "op4_pii", None),
    "op5_exact_dedup": ("exact_dedup", "op5_exact_dedup", "OP5_SQL"),
    "op6_toxicity": ("toxicity", "op6_toxicity", None),
    "op7_jaccard_join": ("jaccard_join", "op7_jaccard_join", "OP7_SQL"),
    "op8_window_dedup": ("window_dedup", "op8_window_dedup", "OP8_SQL"),
    "op9_piece_sampling": ("piece_sampling", "op9_piece_sampling", None),
    "op10_sharding": ("sharding", "op10_sharding", "OP10_SQL"),
}


def _lazy(module: str, function: str):
    def query(spark, sf_dir):
        return getattr(importlib.import_module(f"gridloom.llm.{module}"), function)(spark, sf_dir)

    query.__name__ = function
    return query


def queries() -> dict:
    return {name: _lazy(module, function) for name, (module, function, _) in REGISTRY.items()}


def oracle_sql() -> dict:
    return {
        name: getattr(importlib.import_module(f"gridloom.llm.{module}"), sql)
        for name, (module, _, sql) in REGISTRY.items()
        if sql
    }
