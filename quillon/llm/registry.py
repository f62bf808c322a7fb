"""The queries of this subpackage and the SQL each is held against."""

from __future__ import annotations

from quillon.llm import chat, decontam, html_cut, langid, licenses, mixing, ngram_join, quality, resharding, toxicity

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_language_id": langid.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_html_extraction": html_cut.query,
    "op5_mixing": mixing.query,
    "op6_toxicity": toxicity.query,
    "op7_resharding": resharding.query,
    "op8_quality_rules": quality.query,
    "op9_license_scans": licenses.query,
    "op10_benchmark_decontamination": decontam.query,
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.SQL,
    "op2_language_id": langid.SQL,
    "op8_quality_rules": quality.SQL,
    "op9_license_scans": licenses.SQL,
    "op3_ngram_jaccard_join": ngram_join.SQL,
    "op10_benchmark_decontamination": decontam.SQL,
}
