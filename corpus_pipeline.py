"""Corpus pipeline: toxic documents out, copies out, near copies out, sources mixed to weights, texts encoded.

Each stage takes the rows that the last one kept and returns the columns of ``documents``; the last returns, for each
row of the mix, its doc_id with the digests of its token ids and of the bytes they decode to. Stages are written to
the shared folder and read again, so a lost executor costs no more than its part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exact_dedup, jaccard_join, mixing, queries, toxicity
from tickloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, jaccard_join.Join(words=5, num=4, den=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, epochs=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.digests(docs, queries.own_bpe(spark))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("mix_sources", mix_sources), ("bpe", encode)]

#: Learnt lexicons and byte-level merges are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
