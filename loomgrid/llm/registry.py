"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL
from corpus_pipeline import run as pipeline

from . import decontamination, mixing, pii, quality, recompression, secrets, simhash, suffixes, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_substring_dedup": recompression.op4_substring_dedup,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
    "pipeline": pipeline,
}

ORACLE = {
    "op2_source_mix": mixing.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op4_substring_dedup": recompression.OP4_SQL,
    "op5_suffix_dedup": suffixes.OP5_SQL,
}
if ORACLE_SQL:
    ORACLE["pipeline"] = ORACLE_SQL
