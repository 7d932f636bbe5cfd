"""Benchmark decontamination: passages of test items are found in documents and taken out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytally.llm.common import documents, numbered, stored
from daytally.session import size_shuffles, tune

#: a word holds no ASCII other than letters and digits
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: what stands between the words once A-Z are lower-cased
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: window hashes that are broadcast at once: 24 bytes each or so
AT_ONCE = 1 << 20

PLAIN = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
# splitting takes a fifteenth of the time that extracting every match does
WORDS = f"array_remove(split({PLAIN}, '{BETWEEN}', -1), '')".replace("\\", "\\\\")


def windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, w (the words), h (their hash): the item's windows of `size` words; an
    item of fewer words is one window, an item without words none."""
    worded = items.selectExpr("item_id", f"{WORDS} AS words").filter("size(words) > 0")
    placed = worded.selectExpr("item_id", "words", f"explode(sequence(1, greatest(1, size(words) - {size - 1}))) AS i")
    return placed.selectExpr("item_id", f"slice(words, i, {size}) AS w").distinct().withColumn("h", F.xxhash64("w"))


def hit_windows(rows: DataFrame, items: DataFrame, size: int = 10, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """scanned: rid, kept, n_words, i, len, at, w - a row with i = 0 for every row of `rows`
    (rid, text, kept), and one for each place i (from 1) where a window w of `len`
    words hashes (at) like one of an item; and the items' windows (stored).

    The texts are read and cut into words once for each `at_once` different windows:
    so many hashes are broadcast as a set, which bounds it whatever the benchmark
    holds, and the next ones are scanned for in a pass of their own. Window
    lengths (size, and those of shorter items) are at most `size` numbers.
    """
    found = stored(windows(items, size), "windows")
    keys = found.select("h").distinct()
    lengths = sorted(r[0] for r in found.select(F.size("w")).distinct().collect())
    passes = max(1, -(-keys.count() // at_once))
    worded = rows.selectExpr("rid", "kept", f"{WORDS} AS words").selectExpr("*", "size(words) AS n_words")

    def scan(part: int) -> DataFrame:
        first = 0 if part == 0 else 1
        # the outer form keeps the optimizer from evaluating the words once more for a filter
        placed = worded.selectExpr("*", f"explode_outer(sequence({first}, n_words, 1)) AS i" if first == 0 else
                                   "explode_outer(CASE WHEN n_words > 0 THEN sequence(1, n_words) END) AS i")
        if len(lengths) > 1:
            one_each = f"CASE WHEN i > 0 THEN array({', '.join(map(str, lengths))}) ELSE array(0) END"
            placed = placed.selectExpr("*", f"explode_outer({one_each}) AS len")
        else:
            placed = placed.selectExpr("*", f"{lengths[0] if lengths else size} AS len")
        placed = placed.filter("i = 0 OR i + len - 1 <= n_words")
        hashed = placed.selectExpr("*", "CASE WHEN i > 0 THEN xxhash64(slice(words, i, len)) END AS at")
        wanted = keys.select(F.col("h").alias("key"))
        if passes > 1:
            wanted = wanted.filter(F.pmod("key", F.lit(passes)) == part)
        met = hashed.join(F.broadcast(wanted), F.expr("at = key"), "left").filter("key IS NOT NULL OR i = 0")
        return stored(met.selectExpr("rid", "kept", "n_words", "i", "len", "at", "slice(words, greatest(i, 1), len) AS w"), "scanned")

    return reduce(DataFrame.unionAll, [scan(p) for p in range(passes)]), found


def contamination(rows: DataFrame, items: DataFrame, size: int = 10, at_once: int = AT_ONCE) -> DataFrame:
    """rid, kept, n_words, n_hit, spans (from, to: stretches of hit words, numbered from 0,
    ascending) and items (item_id of those with a window that occurs, ascending as
    strings) of each row of `rows` (rid: a number, text, and whatever is to be `kept`).

    Words are runs of characters other than ASCII signs and blanks, A-Z lower-cased.
    A window is `size` consecutive words of an item, or the whole item where it has
    fewer. Every window of a document is looked up in a broadcast set of the items'
    hashes inside one pass over the texts; hits are verified word by word. Only hits
    and one short row a document are shuffled, by the row's number.
    """
    scanned, found = hit_windows(rows, items, size, at_once)
    size_shuffles(rows.sparkSession, scanned)
    hits = scanned.filter("i > 0").selectExpr("rid", "i", "len", "at", "w")
    known = found.select(F.col("h").alias("key"), F.col("w").alias("known"), "item_id")
    same = F.expr("at = key AND w = known")
    true = hits.join(known.select("key", "known").distinct(), same, "left_semi")
    before = Window.partitionBy("rid").orderBy("i", "len").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    stretch = true.selectExpr("rid", "i", "len", "i + len AS stop").withColumn("reach", F.max("stop").over(before))
    stretch = stretch.withColumn("k", F.sum(F.expr("CASE WHEN i <= reach THEN 0 ELSE 1 END")).over(upto))
    stretch = stretch.groupBy("rid", "k").agg(F.min("i").alias("i"), F.max("stop").alias("stop"))
    spans = stretch.groupBy("rid").agg(
        F.expr("array_sort(collect_list(struct(i - 1 AS `from`, stop - 1 AS `to`))) AS spans"), F.sum(F.expr("stop - i")).alias("n_hit")
    )
    # a window many documents hold and many items share makes no more rows than the result names
    pairs = hits.select("rid", "at", "w").distinct().join(known, same).select("rid", "item_id").distinct()
    named = pairs.groupBy("rid").agg(F.expr("array_sort(collect_list(CAST(item_id AS STRING))) AS items"))
    per_hit = stored(spans.join(named, "rid").withColumnRenamed("rid", "of_row"), "contaminated")
    whole = scanned.filter("i = 0").join(per_hit, F.expr("rid = of_row"), "left")
    return whole.selectExpr(
        "rid", "kept", "CAST(n_words AS BIGINT) AS n_words", "coalesce(n_hit, 0) AS n_hit",
        "coalesce(spans, CAST(array() AS ARRAY<STRUCT<`from`: INT, `to`: INT>>)) AS spans",
        "coalesce(items, CAST(array() AS ARRAY<STRING>)) AS items",
    )


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", size: int = 10, at_once: int = AT_ONCE) -> DataFrame:
    """docs without what `contamination` finds: with remove="spans" the hit words go,
    with all between them, and what stands around a span stays; with
    remove="documents" a row with any hit goes.

    Null and empty texts, and all rows without a hit, are returned as they are, repeated
    rows and rows without doc_id each for itself (rows are numbered in a stored copy).
    An empty benchmark or one without words takes nothing out. A text that holds
    nothing but test passages becomes what its separators leave. Ties do not
    occur; other columns are kept, whatever their names. Texts of any length are
    handled in one row of Spark's, of at most 2 GB.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    rows = numbered(docs.select(F.struct(*docs.columns).alias("whole"), "text"), "whole", "text")
    hit = contamination(rows.selectExpr("rid", "text", "NULL AS kept"), items, size, at_once).filter("n_hit > 0")
    hit = hit.select(F.col("rid").alias("of_row"), "spans")
    if remove == "documents":
        return rows.join(hit, F.expr("rid = of_row"), "left_anti").select("whole.*")
    word = ANY_WORD.replace("\\", "\\\\")
    cut = rows.join(hit, F.expr("rid = of_row"), "left").selectExpr(
        "whole", "text", "spans",
        f"CASE WHEN spans IS NOT NULL THEN regexp_extract_all(text, '{word}', 0) END AS words",
        f"CASE WHEN spans IS NOT NULL THEN split(text, '{word}', -1) END AS gaps",
    )
    pieces = "zip_with(gaps, words, (g, w) -> concat(g, coalesce(w, '')))"
    # before each span: the pieces since the last one, then the gap in front of the span
    part = (
        "transform(spans, (s, k) -> concat(array_join(slice(pieces, CASE WHEN k = 0 THEN 1 ELSE spans[k - 1].`to` + 1 END, "
        "s.`from` - CASE WHEN k = 0 THEN 0 ELSE spans[k - 1].`to` END), ''), gaps[s.`from`]))"
    )
    rest = "array_join(slice(pieces, element_at(spans, -1).`to` + 1, size(pieces)), '')"
    cut = cut.selectExpr("whole", "text", "spans", "gaps", f"{pieces} AS pieces")
    cut = cut.selectExpr("whole", f"CASE WHEN spans IS NULL THEN text ELSE concat(array_join({part}, ''), {rest}) END AS cleaned")
    return cut.select(*[F.col("cleaned").alias("text") if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("kept"), "text")
    items = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(docs, items)
    return found.selectExpr(
        "kept AS doc_id", "n_words", "n_hit", "CAST(size(items) AS BIGINT) AS n_items",
        "sha2(array_join(items, ','), 256) AS items_sha256", "n_hit > 0 AS contaminated",
    )


ORACLE = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tests AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM tests WHERE len(w) > 0)),
sized AS (SELECT doc_id, w, n FROM worded, (SELECT DISTINCT n FROM windows)),
placed AS (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized),
hits AS (
  SELECT doc_id, i, p.n, item_id FROM placed p JOIN windows t ON t.n = p.n AND t.s = array_to_string(list_slice(w, i, i + p.n - 1), ' ')),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""
