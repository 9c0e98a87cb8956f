"""Queries of this subpackage by name, and the SQL that some of them equal."""

from tessera.llm import caps, jaccard, lines, mixing, ngram, packing, quality, substring, token_files, toxicity

QUERIES = {
    "op1_lm_score": ngram.op1_lm_score,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_vector_caps": caps.op6_vector_caps,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_token_files": token_files.op8_token_files,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op3_line_dedup": lines.ORACLE_SQL,
    "op4_jaccard_join": jaccard.ORACLE_SQL,
    "op6_vector_caps": caps.ORACLE_SQL,
    "op9_substring_dedup": substring.ORACLE_SQL,
}
