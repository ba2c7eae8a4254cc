"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: name of the query: the module that holds it.
MODULES = {
    "op1_embedding_near_duplicates": "embedding_dedup",
    "op2_quality_rules": "quality_rules",
    "op3_backoff_scores": "lm_scoring",
    "op4_jump_sharding": "sharding",
    "op5_pack_sequences": "packing",
    "op6_neighbour_quality": "quality_classifier",
    "op7_piece_round_trip": "sentencepieces",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_jaccard_join": "jaccard_join",
    "op10_chat_prefix_trees": "chat",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
