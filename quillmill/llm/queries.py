"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from quillmill.llm import ann, bpe, chat, decontaminate, language, linededup, neardup, quality, ranking, repair, tokenfile, toxicity, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_language_id": language.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_ann": ann.op6_ann,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_simhash_near_dedup": neardup.op9_simhash_near_dedup,
    "op10_url_filters": urls.op10_url_filters,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_lexical_search": ranking.op12_lexical_search,
    "op13_token_output": tokenfile.op13_token_output,
}

ORACLE_SQL = {
    "op7_decontamination": decontaminate.OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op10_url_filters": urls.OP10_SQL,
    "op12_lexical_search": ranking.OP12_SQL,
}
