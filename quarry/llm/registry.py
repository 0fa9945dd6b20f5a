"""Queries of the llm subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from quarry.llm import (
    decontamination,
    hmm_scoring,
    jaccard_join,
    language_id,
    line_dedup,
    quality_cnn,
    quality_rules,
    source_mix,
    substring_dedup,
    token_counts,
)


def queries():
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_token_counts": token_counts.query,
        "op3_quality_cnn": quality_cnn.query,
        "op4_hmm_scoring": hmm_scoring.query,
        "op5_mix_sources": source_mix.query,
        "op6_quality_rules": quality_rules.query,
        "op7_language_id": language_id.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_line_dedup": line_dedup.query,
        "op10_decontamination": decontamination.query,
    }


def oracle_sql():
    return {
        "op5_mix_sources": source_mix.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op10_decontamination": decontamination.ORACLE_SQL,
    }
