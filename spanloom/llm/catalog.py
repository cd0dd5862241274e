"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (
    alignment,
    best_fit,
    decontaminate,
    divergence,
    language_id,
    license_scan,
    near_dup,
    pii,
    quality_rules,
    sentencepiece_fst,
    substring_dedup,
    token_shards,
    toxicity,
)

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_sentencepiece": sentencepiece_fst.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_near_dup": near_dup.query,
    "op5_token_shards": token_shards.query,
    "op6_language_id": language_id.query,
    "op7_line_quality": quality_rules.query,
    "op8_pii": pii.query,
    "op9_toxicity": toxicity.query,
    "op10_decontaminate": decontaminate.query,
    "op11_best_fit": best_fit.query,
    "op12_divergence": divergence.query,
    "op13_alignment": alignment.query,
}

ORACLE = {
    "op1_license_scan": license_scan.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op7_line_quality": quality_rules.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
