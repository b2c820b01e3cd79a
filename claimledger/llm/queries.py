"""Queries and oracles of the subpackage, gathered for the entry file."""

from __future__ import annotations

from claimledger.llm import (chat, decontaminate, embeddings, language, mixing, ngram_join, quality, secrets, spelling,
                             tokens, toxicity, vector_codes, zipwarc)


def queries():
    return {
        "op1_tokens": tokens.q_tokens,
        "op2_ngram_join": ngram_join.q_ngram_join,
        "op3_decontaminate": decontaminate.q_decontaminate,
        "op4_warc": zipwarc.q_warc,
        "op5_secrets": secrets.q_secrets,
        "op6_mixing": mixing.q_mixing,
        "op7_toxicity": toxicity.q_toxicity,
        "op8_chat": chat.q_chat,
        "op9_language": language.q_language,
        "op10_embeddings": embeddings.q_embeddings,
        "op11_vector_codes": vector_codes.q_vector_codes,
        "op12_quality": quality.q_quality,
        "op13_spelling": spelling.q_spelling,
    }


def oracle_sql():
    return {
        "op2_ngram_join": ngram_join.SQL,
        "op4_warc": zipwarc.SQL,
        "op6_mixing": mixing.SQL,
        "op8_chat": chat.SQL,
        "op10_embeddings": embeddings.SQL,
        "op11_vector_codes": vector_codes.SQL,
        "op13_spelling": spelling.SQL,
    }
