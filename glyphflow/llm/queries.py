"""Contract queries of the corpus operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, html_extract, language_id, ngram_join, pii, sentence_pieces, sharding, substring_dedup, url_filter


def queries() -> dict:
    return {
        "op1_sharding": sharding.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_language_id": language_id.query,
        "op4_url_filter": url_filter.query,
        "op5_html_extract": html_extract.query,
        "op6_sentence_pieces": sentence_pieces.query,
        "op7_embedding_dedup": embedding_dedup.query,
        "op8_pii": pii.query,
        "op9_ngram_join": ngram_join.query,
        "op10_decontaminate": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op9_ngram_join": ngram_join.ORACLE_SQL,
        "op10_decontaminate": decontaminate.ORACLE_SQL,
    }
