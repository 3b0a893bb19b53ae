"""The queries of the training-data operators."""

from lodework.llm import embedding_dedup, language_id, minhash_dedup, quality_rules, secret_scan, sentence_pieces, source_mixing, substring_dedup, token_ids, toxicity

QUERIES = {
    "op1_token_ids": token_ids.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_sentence_pieces": sentence_pieces.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "op5_minhash_dedup": minhash_dedup.query,
    "op6_source_mixing": source_mixing.query,
    "op7_secret_scan": secret_scan.query,
    "op8_toxicity": toxicity.query,
    "op9_language_id": language_id.query,
    "op10_quality_rules": quality_rules.query,
}
ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_embedding_dedup": embedding_dedup.ORACLE,
    "op5_minhash_dedup": minhash_dedup.ORACLE,
    "op6_source_mixing": source_mixing.ORACLE,
}
