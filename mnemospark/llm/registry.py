"""Queries and oracle SQL of the llm operators, for the entry module."""

from __future__ import annotations

from . import op1_decontaminate, op2_secrets, op3_token_files, op4_repeats, op5_quality, op6_packing, op7_token_counts, op8_pii, op9_simhash, op10_warc

QUERIES = {
    "op1_decontamination": op1_decontaminate.op1_decontamination,
    "op2_secret_scan": op2_secrets.op2_secret_scan,
    "op3_token_files": op3_token_files.op3_token_files,
    "op4_repeated_bytes": op4_repeats.op4_repeated_bytes,
    "op5_quality_rules": op5_quality.op5_quality_rules,
    "op6_curve_packing": op6_packing.op6_curve_packing,
    "op7_token_counts": op7_token_counts.op7_token_counts,
    "op8_personal_data": op8_pii.op8_personal_data,
    "op9_simhash_near_dedup": op9_simhash.op9_simhash_near_dedup,
    "op10_warc": op10_warc.op10_warc,
}
ORACLES: dict[str, str] = {
    "op5_quality_rules": op5_quality.ORACLE,
    "op10_warc": op10_warc.ORACLE,
}
