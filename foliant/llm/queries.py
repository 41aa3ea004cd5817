"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, embeddings, fingerprint, minhash, mixing, packing, quality, substring, tokens, urls

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_mixing": mixing.op2_mixing,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_document_fingerprints": fingerprint.op4_document_fingerprints,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_embedding_duplicates": embeddings.op8_embedding_duplicates,
    "op9_url_filters": urls.op9_url_filters,
    "op10_repeated_passages": substring.op10_repeated_passages,
}

ORACLES = {
    "op1_near_duplicates": minhash.OP1_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op8_embedding_duplicates": embeddings.OP8_SQL,
    "op9_url_filters": urls.OP9_SQL,
    "op10_repeated_passages": substring.OP10_SQL,
}
