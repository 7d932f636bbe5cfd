"""Exact dedup: a Bloom filter of hashes met twice decides which rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.llm.common import BLANK, documents, stored


def filter_bits(rows: int, bits_per_row: int, most_bits: int) -> int:
    """A power of two above bits_per_row for each row, but not above most_bits; 64 at least."""
    return 1 << max(6, min(most_bits.bit_length() - 1, (bits_per_row * rows).bit_length()))


def exact_duplicates(docs: DataFrame, bits_per_row: int = 16, most_bits: int = 1 << 27) -> DataFrame:
    """One row per document with the document that stays for it.

    Texts are equal when they are identical after ASCII white space is deleted.
    The longest original text (in code points) stays, then the smallest doc_id.

    First pass: each row's hash picks one bit of the filter, and rows are counted
    per bit, so that only words with a bit met twice are left; a key of 12 bytes and
    a count shuffle for each bit that a task has met. Second pass: the
    filter, at most most_bits / 64 words of 16 bytes whatever the input, is
    broadcast. A row whose bit was met once has no equal and passes straight
    through; the others shuffle on the SHA-256 of their text. The filter errs
    towards shuffling only, so a filter that is too small costs time, not rows.

    A copied group is counted before its shuffle and the copies are joined to one
    row per group, so that a join task holding a hot group can be split.

    Null text counts as empty, and all empty texts are one group. A missing
    doc_id sorts last; rows repeated in full are all reported and all count; they
    share keep_id, so `kept` is true for each of them. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    prints = stored(
        docs.select("doc_id", F.char_length(text).alias("chars"), F.unhex(F.sha2(F.regexp_replace(text, BLANK, ""), 256)).alias("sha")),
        "prints",
    )
    bits = filter_bits(prints.count(), bits_per_row, most_bits)
    at = F.pmod(F.xxhash64("sha"), F.lit(bits))
    marked = prints.withColumns({"word": F.shiftright(at, 6), "bit": (at % 64).cast("int")})
    twice = (
        marked.groupBy("word", "bit")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )
    twice = F.broadcast(stored(twice, "filter"))
    seen = marked.join(twice, "word", "left").withColumn("again", F.expr("bits IS NOT NULL AND getbit(bits, bit) = 1"))
    again = seen.filter("again").select("doc_id", "chars", "sha")
    # most code points, then smallest doc_id, missing ones last
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("no"), "doc_id"))
    groups = again.groupBy("sha").agg(best.alias("best"), F.count("*").alias("size"))
    groups = stored(groups.filter("size > 1").select("sha", F.col("best.doc_id").alias("best_id"), "size"), "groups")
    alone = seen.filter("NOT again").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    grouped = again.join(groups, "sha", "left").select(
        "doc_id",
        "sha",
        F.expr("CASE WHEN size IS NULL THEN doc_id ELSE best_id END AS keep_id"),
        F.expr("coalesce(size, 1L) AS group_size"),
    )
    return alone.unionAll(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.expr("doc_id <=> keep_id AS kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM t
"""
