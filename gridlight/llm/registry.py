"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query -> the module that defines it.
QUERIES = {
    "op1_attention_scores": "language_model",
    "op2_main_text": "html_text",
    "op3_toxicity": "toxicity",
    "op4_min_max_hash": "near_duplicates",
    "op5_decontamination": "decontaminate",
    "op6_arrow_token_files": "arrow_tokens",
    "op7_histogram_shards": "sharding",
    "op8_feistel_pseudonyms": "pseudonyms",
    "op9_rotation_codes": "embedding_links",
    "op10_byte_bpe": "bpe",
    "op11_boosted_quality": "quality",
    "op12_residue_whitening": "whitening",
    "op13_group_alignment": "alignment",
}


def queries() -> dict:
    return {name: getattr(import_module(f"gridlight.llm.{m}"), name) for name, m in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in sorted({*QUERIES.values()}) for name, sql in getattr(import_module(f"gridlight.llm.{m}"), "ORACLES", {}).items()}
