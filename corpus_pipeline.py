"""Corpus pipeline: language, near copies, repeated passages, benchmark passages, pieces.

Each stage takes the documents that its predecessor kept and works on all of them.
Language identification drops what it rejects, the n-gram join keeps one document of
each group, suffix dedup removes repeated passages from the texts (and texts that lose
everything), decontamination drops documents with a benchmark window, and the last
stage puts SentencePiece ids in place of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontam, langid, ngram_join, pieces, suffix_dedup
from logweave.llm.common import cut, prepare


def _prepared(fn):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, docs, sf_dir)
    stage.__doc__ = fn.__doc__
    return stage


STAGES = [
    ("language_id", _prepared(langid.stage)),
    ("ngram_join", _prepared(ngram_join.stage)),
    ("suffix_dedup", _prepared(suffix_dedup.stage)),
    ("decontamination", _prepared(decontam.stage)),
    ("sentencepiece", _prepared(pieces.stage)),
]

#: the stages are beyond SQL; tests/llm hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES[:-1]:
        docs = cut(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
