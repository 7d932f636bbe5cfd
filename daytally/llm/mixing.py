"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytally.llm.common import WORD, documents, stored

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources, by code point and null last, take the weights in turn and share
    `share` of all sizes by them. No target goes above `most` times its source;
    what is cut off is shared again by weight among the rest. The end of that is
    a level L with target = least(cap, L * weight); with the sources ordered by
    cap / weight, L follows from running sums. The two windows without a key run
    over one row per source.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("n", F.row_number().over(by_name) - 1).withColumns(
        {"weight": weight.cast("double"), "cap": F.col("source_size") * float(most)}
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    held = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "n", "level"))).over(everything)
    return held.withColumn("final", final["level"]).select(
        "source", "source_size", F.least("cap", F.col("final") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per row of
    docs, and the column `key` if it is another one.

    A document of a source with rate r = target / source_size is expected r times.
    Documents are lined up within their source, the expected copies are summed
    along the line from one random offset, and a document is emitted once for
    each integer the sum crosses: at most ceil(r) <= `most` times. The line runs
    from small sizes to large, so the words taken come near the target too.

    The line is cut into blocks by size class and doc_id, so a hot source is
    numbered by many tasks: a block's rows are numbered on their own, and the
    rows of earlier blocks are added from one row per block. The number of blocks
    grows with the square root of the rows, which keeps both steps small.

    Size is the number of words; null text has none and is taken 0 times its
    words. A null source is a source of its own. Rows repeated in full each stand
    in the line. Results depend on rows and seed alone. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    keys = dict.fromkeys(["doc_id", key])
    sizes = stored(docs.select(*keys, "source", size.alias("size")), "sizes")
    blocks = max(1, math.isqrt(sizes.count()) // 20)
    lined = sizes.withColumns({"class": F.length(F.bin("size")), "block": F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(blocks))})
    cells = stored(lined.groupBy("source", "class", "block").agg(F.count("*").alias("rows")), "cells")
    earlier = Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    targets = source_targets(sizes, weights, share, most)
    # one row per block: source, class, block, start, source_size, target
    cells = stored(
        cells.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("c.*", "source_size", "target"), "blocks"
    ).withColumnsRenamed({"source": "s", "class": "k", "block": "b"})
    within = Window.partitionBy("source", "class", "block").orderBy("size", *keys)
    placed = lined.withColumn("nth", F.row_number().over(within)).join(cells, F.expr("source <=> s AND class = k AND block = b"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("\0")), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = placed.withColumns({"rate": rate, "offset": drawn / float(1 << 32), "place": F.col("start") + F.col("nth")})
    copies = F.floor(F.col("place") * F.col("rate") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("rate") + F.col("offset"))
    return placed.withColumn("copies", copies).select(
        *keys, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; see `mix`. Rows are told apart by
    128 bits of all their columns, so that rows repeated in full are one with their copies
    added up, and rows that differ in any column, whichever, are not."""
    row = F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit(1), *docs.columns).alias("b")).alias("row")
    drawn = mix(docs.select("doc_id", "source", "text", row), **settings, key="row").groupBy("row").agg(F.sum("copies").alias("times"))
    drawn = stored(drawn.filter("times > 0").withColumnRenamed("row", "drawn"), "drawn")
    once = docs.select(row, F.struct(*docs.columns).alias("whole")).dropDuplicates(["row"])
    taken = once.join(drawn, F.expr("row = drawn")).select("whole", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return taken.select("whole.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: also the base of the pipeline's SQL; {docs} is a relation with doc_id, source, text
ORACLE_OF = r"""
sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}),
blocks AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT) // 20) AS n FROM sizes),
lined AS (
  SELECT *, length(bin(size)) AS class, coalesce(doc_id, 0) % (SELECT n FROM blocks) AS block,
         row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), coalesce(doc_id, 0) % (SELECT n FROM blocks), size, doc_id) AS place
  FROM sizes),
ranked AS (
  SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS n, CAST(2 * source_size AS DOUBLE) AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM ranked) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
final AS (SELECT level AS final FROM levels WHERE level * weight <= cap ORDER BY cap / weight, n LIMIT 1),
targets AS (SELECT source, source_size, least(cap, final * weight) AS target FROM levels, final),
mixed AS (
  SELECT doc_id, size, source_size, target,
         CAST(floor(place * rate + "offset") - floor((place - 1) * rate + "offset") AS BIGINT) AS copies
  FROM (SELECT l.doc_id, l.size, l.place, t.source_size, t.target,
               CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
               CAST(('0x' || substr(md5(coalesce(l.source, chr(0)) || '|0'), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS "offset"
        FROM lined l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source))
"""
ORACLE = f"WITH {ORACLE_OF.format(docs='documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
