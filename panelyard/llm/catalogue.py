"""The queries of this folder by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, jaccard, mixing, repeats, sharding, token_orc, topk, toxicity, wrappers

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_ngram_jaccard": jaccard.query,
    "op3_sharding": sharding.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_source_mixing": mixing.query,
    "op6_repeated_passages": repeats.query,
    "op7_toxicity": toxicity.query,
    "op8_token_orc": token_orc.query,
    "op9_html_wrappers": wrappers.query,
    "op10_exact_topk": topk.query,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op5_source_mixing": mixing.SQL,
    "op10_exact_topk": topk.SQL,
}
