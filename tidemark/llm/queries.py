"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import additive, conversations, decontaminate, langid, lexical, neardup, pieces, quality, secrets, sharding, substrings, tokencounts, warc

QUERIES = {
    "op1_suffix_array": substrings.op1_suffix_array,
    "op2_token_counts": tokencounts.op2_token_counts,
    "op3_language_id": langid.op3_language_id,
    "op4_warc": warc.op4_warc,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_quality_classifier": additive.op11_quality_classifier,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLE = quality.ORACLE | decontaminate.ORACLE | lexical.ORACLE | conversations.ORACLE
