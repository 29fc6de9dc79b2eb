"""Queries of the numbered operators and of the pipeline, and their SQL where there is one."""

from __future__ import annotations

from foliant.llm import (
    chat,
    decontamination,
    exact_topk,
    html_extraction,
    language,
    lexical_search,
    near_duplicates,
    packing,
    quality,
    secrets,
    toxicity,
    url_filter,
    vector_codes,
)


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": near_duplicates.query,
        "op2_secret_scan": secrets.query,
        "op3_exact_topk": exact_topk.query,
        "op4_html_extraction": html_extraction.query,
        "op5_packing": packing.query,
        "op6_decontamination": decontamination.query,
        "op7_language_id": language.query,
        "op8_url_filter": url_filter.query,
        "op9_toxicity": toxicity.query,
        "op10_chat_format": chat.query,
        "op11_vector_codes": vector_codes.query,
        "op12_lexical_search": lexical_search.query,
        "op13_quality_rules": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.ORACLE_SQL,
        "op3_exact_topk": exact_topk.ORACLE_SQL,
        "op6_decontamination": decontamination.ORACLE_SQL,
        "op8_url_filter": url_filter.ORACLE_SQL,
        "op10_chat_format": chat.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL,
        "op12_lexical_search": lexical_search.ORACLE_SQL,
    }
