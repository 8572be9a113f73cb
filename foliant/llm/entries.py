"""Queries of the training-data operators, with their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline
from foliant.llm import decontamination, digest_index, language_id, line_dedup, merkle, near_dedup, packing, periodic_runs, pii, quality_classifier, quality_rules, substring_dedup, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_pii": pii.op3_pii,
    "op4_language_id": language_id.op4_language_id,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_packing": packing.op10_packing,
    "op11_exact_dedup": digest_index.op11_exact_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_url_filters": url_filters.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op11_exact_dedup": digest_index.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
