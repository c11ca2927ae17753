"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import ann, brown, language_id, mixing, pii, quality, secrets, sentencepiece_unigram, simhash, topk

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_importance_resampling": quality.op2,
    "op3_exact_topk": topk.op3,
    "op4_pii_boosted_spans": pii.op4,
    "op5_sentencepiece_unigram": sentencepiece_unigram.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_rank_order_language_id": language_id.op7,
    "op8_min_cost_flow_mix": mixing.op8,
    "op9_brown_class_lm": brown.op9,
    "op10_rotated_bit_codes": ann.op10,
}

ORACLE_SQL = {"op3_exact_topk": topk.ORACLE}
