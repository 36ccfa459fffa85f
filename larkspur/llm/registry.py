"""The queries of this subpackage and their DuckDB equivalents where SQL can express them."""

from larkspur.llm import bpe, conversations, hamming, importance, language, line_dedup, mixing, near_dups, quality, secrets, suffix_dedup, token_files, url_rules

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_hamming_topk": hamming.op2_hamming_topk,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_token_files": token_files.op5_token_files,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_language_id": language.op9_language_id,
    "op10_minhash_near_dedup": near_dups.op10_minhash_near_dedup,
    "op11_url_filters": url_rules.op11_url_filters,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLES = {
    "op2_hamming_topk": hamming.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_url_filters": url_rules.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
