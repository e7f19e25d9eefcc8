"""Queries of this subpackage, one per operator, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from scatterspark.llm import op1_toxicity, op2_embedding_dedup, op3_packing, op4_surrogates, op5_quality, op6_language, op7_decontaminate, op8_line_dedup, op9_chat, op10_jaccard_join

QUERIES = {
    "op1_counterfactual_toxicity": op1_toxicity.query,
    "op2_rotation_codes": op2_embedding_dedup.query,
    "op3_length_buckets": op3_packing.query,
    "op4_surrogates": op4_surrogates.query,
    "op5_attention_quality": op5_quality.query,
    "op6_string_kernel_language": op6_language.query,
    "op7_spaced_seeds": op7_decontaminate.query,
    "op8_fuzzy_lines": op8_line_dedup.query,
    "op9_perspective_rotation": op9_chat.query,
    "op10_token_group_join": op10_jaccard_join.query,
}
ORACLES = {
    "op2_rotation_codes": op2_embedding_dedup.ORACLE,
    "op9_perspective_rotation": op9_chat.ORACLE,
    "op10_token_group_join": op10_jaccard_join.ORACLE,
}
