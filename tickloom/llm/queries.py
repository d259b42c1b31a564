"""Queries of the text operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, conversations, exact_dedup, fingerprints, mixing, near_dup, pii, quality, runs, secrets, sharding, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1,
        "op2_secret_scan": secrets.op2,
        "op3_quality_rules": quality.op3,
        "op4_pii": pii.op4,
        "op5_sharding": sharding.op5,
        "op6_mixing": mixing.op6,
        "op7_toxicity": toxicity.op7,
        "op8_ngram_join": near_dup.op8,
        "op9_bpe": bpe.op9,
        "op10_substring_dedup": substring_dedup.op10,
        "op11_periodic_runs": runs.op11,
        "op12_fingerprints": fingerprints.op12,
        "op13_conversation_repair": conversations.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op3_quality_rules": quality.sql(),
        "op8_ngram_join": near_dup.SQL,
        "op10_substring_dedup": substring_dedup.SQL,
    }
