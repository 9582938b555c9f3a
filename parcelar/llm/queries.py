"""Queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, hamming_search, jaccard_join, pii, quality, secrets, sentencepiece_codec, sharding, suffix_dedup, token_counts

QUERIES = {
    "op10_secrets": secrets.op10_secrets,
    "op4_hamming_search": hamming_search.op4_hamming_search,
    "op8_quality": quality.op8_quality,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
    "op6_token_counts": token_counts.op6_token_counts,
    "op2_pii": pii.op2_pii,
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op9_decontamination": decontamination.op9_decontamination,
}

ORACLES = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op2_pii": pii.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op4_hamming_search": hamming_search.SQL,
    "op5_sharding": sharding.SQL,
    "op9_decontamination": decontamination.SQL,
}
