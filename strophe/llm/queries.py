"""The operators' registered queries and their SQL."""

from __future__ import annotations

from strophe.llm import bpe, conversations, embedding_dedup, exact_dedup, langid, licenses, lm_scoring, merkle, minhash_dedup, mixing, packing, quality, token_counts

QUERIES = {
    "op1_quality": quality.query,
    "op2_language": langid.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_token_counts": token_counts.query,
    "op5_lm_scoring": lm_scoring.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_packing": packing.query,
    "op8_licenses": licenses.query,
    "op9_mixing": mixing.query,
    "op10_minhash_dedup": minhash_dedup.query,
    "op11_merkle_manifest": merkle.query,
    "op12_bpe": bpe.query,
    "op13_conversations": conversations.query,
}

ORACLES = {
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "op5_lm_scoring": lm_scoring.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op10_minhash_dedup": minhash_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_conversations": conversations.ORACLE,
}
