"""A corpus pipeline: language ID, line dedup, near duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytally.llm import bpe, langid, line_dedup, mixing, ngram_join
from daytally.llm.common import BLANK, documents, stored


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised. The languages are learned from
    a bounded sample of the stage's own input."""
    whole = docs.select("doc_id", "lang", "text", F.struct(*docs.columns).alias("whole"))  # read from `whole` alone when scored
    found = langid.identify(whole, "true", langid.Settings(), "whole")
    return found.filter("NOT rejected").select("whole.*")


def line_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those of which no
    word is left go. n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.filter(F.expr("n_removed = 0") | (F.char_length(F.regexp_replace("text", BLANK, "")) > 0))
    return left.withColumn("n_chars", F.expr("CASE WHEN n_removed > 0 THEN char_length(text) ELSE n_chars END")).select(*docs.columns)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, bpe.public_vocabulary(), ids=True, digests=True)


STAGES = [
    ("language_id", identified),
    ("line_dedup", line_deduped),
    ("ngram_join", near_deduped),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: a classifier and a tokenizer are not SQL; the tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
