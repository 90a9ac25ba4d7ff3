"""Registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, lexical_search, merkle, mixing, ngram_join, pieces, secrets, toxicity, url_filter, vectors, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op6_document_fingerprints": fingerprints.query,
    "op4_secret_scans": secrets.query,
    "op7_embedding_near_dedup": vectors.query,
    "op2_toxicity": toxicity.query,
    "op3_sentencepiece": pieces.query,
    "op5_source_mixing": mixing.query,
    "op8_chat_formatting": chat.query,
    "op9_url_filters": url_filter.query,
    "op10_warc": warc.query,
    "op11_ranked_lexical_search": lexical_search.query,
    "op12_decontamination": decontaminate.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLES = {
    "op8_chat_formatting": chat.ORACLE,
    "op9_url_filters": url_filter.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_ranked_lexical_search": lexical_search.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
