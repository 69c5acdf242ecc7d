"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from logweave.llm import chat, decontam, embed_dedup, langid, licenses, merkle, ngram_join, phrases, pieces, quality, suffix_dedup, token_counts, token_store
from logweave.llm.common import prepare

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_language_id": langid.op2_language_id,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_embedding_dedup": embed_dedup.op5_embedding_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality_ranking": quality.op9_quality_ranking,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_token_store": token_store.op12_token_store,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op3_decontamination": decontam.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_embedding_dedup": embed_dedup.OP5_SQL,
    "op11_phrase_collocations": phrases.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}


def queries() -> dict:
    def wrap(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        return run
    return {k: wrap(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
