"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import contamination, conversations, jaccard, minmax, mixing_lm, mixture, quality, resampling, secrets, sharding, substrings, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        mixing_lm.op1_mixing_lm, quality.op2_quality_rules, secrets.op3_secret_scan, token_counts.op4_token_counts, substrings.op5_substring_dedup,
        contamination.op6_decontaminate, sharding.op7_sharding, jaccard.op8_jaccard_join, mixture.op9_curriculum_mix, toxicity.op10_toxicity,
        minmax.op11_minmax_dedup, conversations.op12_conversation_repair, resampling.op13_importance_resampling,
    )
}

ORACLES = {
    "op5_substring_dedup": substrings.ORACLE_SQL, "op6_decontaminate": contamination.ORACLE_SQL, "op7_sharding": sharding.ORACLE_SQL,
    "op8_jaccard_join": jaccard.ORACLE_SQL, "op9_curriculum_mix": mixture.ORACLE_SQL,
    "op11_minmax_dedup": minmax.ORACLE_SQL, "op12_conversation_repair": conversations.ORACLE_SQL, "op13_importance_resampling": resampling.ORACLE_SQL,
}
