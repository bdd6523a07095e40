"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, conversation_repair, embedding_dedup, html_text, language_id, lexical_search, minhash, mixing, ngram_lm, pii, quality_rules, sentencepiece_fst, toxicity

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_pii": pii.op2_pii,
    "op3_mixing": mixing.op3_mixing,
    "op4_html_text": html_text.op4_html_text,
    "op5_language_id": language_id.op5_language_id,
    "op6_sentencepiece": sentencepiece_fst.op6_sentencepiece,
    "op7_stupid_backoff": ngram_lm.op7_stupid_backoff,
    "op7_trigram_backoff": ngram_lm.op7_trigram_backoff,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_chat": chat.op9_chat,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op1_minhash": minhash.oracle_sql(),
    "op3_mixing": mixing.ORACLE_SQL,
    "op7_stupid_backoff": ngram_lm.ORACLE_SQL,
    "op7_trigram_backoff": ngram_lm.TRIGRAM_SQL,
    "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
