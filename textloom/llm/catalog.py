"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, golden_record, hard_negatives, license_scan, mixing, ngram_join, packing, quality_model, quality_rules, secret_scan, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_packing": packing.op11_packing,
    "op12_golden_record": golden_record.op12_golden_record,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op1_license_scan": license_scan.oracle,
    "op5_secret_scan": secret_scan.oracle,
    "op9_quality_rules": quality_rules.oracle,
    "op12_golden_record": golden_record.oracle,
    "op13_hard_negatives": hard_negatives.oracle,
}
