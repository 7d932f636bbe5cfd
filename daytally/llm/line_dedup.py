"""Line dedup: lines within one edit of an earlier line, by a join of deletion variants."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.llm.common import documents, each, in_filter, met_twice, stored

#: the ASCII white space that is trimmed off lines
TRIM = " \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def long_lines(text: str, least: int) -> list[tuple[int, str]]:
    """Number and trimmed text of the lines with at least `least` code points."""
    return [(i, t) for i, line in enumerate(text.split("\n")) if len(line) >= least and len(t := line.strip(TRIM)) >= least]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_keys(line: str, blocks: int) -> list[tuple[int, int, int]]:
    """(key, first, last): what stands outside each block of the line.

    Two lines one edit apart agree outside the block that holds the edit. The
    blocks divide the shorter line's length, so a line has a set of keys for its
    own length and one for a character less, where its block is one longer.
    """
    n = len(line)
    made = []
    for base in (n, n - 1):
        for k in range(blocks):
            first, last = k * base // blocks, (k + 1) * base // blocks + n - base
            made.append((signed(xxhash.xxh3_64_intdigest(f"{line[:first]}\0{line[last:]}".encode(), base * blocks + k)), first, last))
    return made


def deletions(line: str, first: int, last: int) -> np.ndarray:
    """Hashes of the line without the character at each place from first to last."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(codes) - 1, BASE)])
    sums = np.r_[np.uint64(0), np.cumsum(codes * power)]
    at = np.arange(first, last)
    return sums[at] + (sums[-1] - sums[at + 1]) * BACK


def whole(line: str) -> int:
    """The hash of the line as it is, comparable to `deletions`."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    return int((codes * np.cumprod(np.r_[np.uint64(1), np.full(len(codes) - 1, BASE)])).sum())


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, row, line, h of every line that counts."""

    def one(batch):
        doc, row, line, h = [], [], [], []
        for d, r, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            for i, x in long_lines(t or "", least):
                doc.append(d), row.append(r), line.append(i), h.append(hashlib.md5(x.encode()).digest())
        return [doc, row, line, h]

    columns = {"doc_id": pa.int64(), "row": pa.int64(), "line": pa.int32(), "h": pa.binary()}
    return docs.mapInArrow(each(one, columns), "doc_id long, row long, line int, h binary")


#: orders lines: missing doc_ids last, then by doc_id, row and line
PLACE = "struct<no:boolean,doc_id:bigint,row:bigint,line:int>"


def place():
    return F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row", "line")


def _near_candidates(docs: DataFrame, least: int, blocks: int) -> DataFrame:
    """Distinct lines (h, text, at) that may agree with another outside one block;
    `at` is the first place of the line."""

    def keys(batch):
        return [[k for t in batch.column("text").to_pylist() for _, x in long_lines(t or "", least) for k, _, _ in block_keys(x, blocks)]]

    bits = met_twice(docs.mapInArrow(each(keys, {"h": pa.int64()}), "h long"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def lines(batch):
        bits, out = shared.value, ([], [], [], [], [])
        for d, r, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            own = long_lines(t or "", least)
            if own:
                made = np.array([[k for k, _, _ in block_keys(x, blocks)] for _, x in own], np.int64)
                for i in np.flatnonzero(in_filter(bits, made).any(axis=1)).tolist():
                    for column, v in zip(out, (d, r, own[i][0], hashlib.md5(own[i][1].encode()).digest(), own[i][1]), strict=True):
                        column.append(v)
        return out

    columns = {"doc_id": pa.int64(), "row": pa.int64(), "line": pa.int32(), "h": pa.binary(), "text": pa.string()}
    found = docs.mapInArrow(each(lines, columns), "doc_id long, row long, line int, h binary, text string")
    return stored(found.groupBy("h").agg(F.first("text").alias("text"), F.min(place()).alias("at")), "candidates")


def near_lines(docs: DataFrame, least: int, blocks: int) -> DataFrame:
    """h of the lines of which a different line, one edit away, has an earlier first place.

    First the keys of `block_keys` are compared: only lines that agree with
    another outside some block go on, with that block. Of these, the variants with
    a character of the block deleted are the keys of the join. Lines of one
    length that share a variant at one place differ there alone, so each is
    paired with the earliest of them; a longer line is paired with the line that
    one of its variants is. So the pairs grow with the lines. The edit
    distance of every pair is verified.
    """
    lines = _near_candidates(docs, least, blocks)

    def keyed(batch):
        h, key, first, last = [], [], [], []
        for a, x in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for k, i, j in block_keys(x, blocks):
                h.append(a), key.append(k), first.append(i), last.append(j)
        return [h, key, first, last]

    types = {"h": pa.binary(), "key": pa.int64(), "first": pa.int32(), "last": pa.int32()}
    keys = lines.mapInArrow(each(keyed, types), "h binary, key long, first int, last int")
    met = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("met")), "met")
    spans = keys.join(met, F.expr("key = met")).groupBy("h").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = stored(spans.withColumnRenamed("h", "of"), "spans")
    open_lines = lines.join(spans, F.expr("h = of")).select("h", "text", "at", "spans")

    def varied(batch):
        of, key, cut, size = [], [], [], []
        for i, (x, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "spans")), strict=True)):
            at = np.unique(np.concatenate([np.arange(s["first"], s["last"]) for s in spans]))
            made = deletions(x, 0, len(x))[at].view(np.int64)
            of += [i] * (len(at) + 1)
            key += [*made.tolist(), signed(whole(x))]
            cut += [*at.tolist(), -1]
            size += [len(x) - 1] * len(at) + [len(x)]
        return [batch.column("h").take(pa.array(of, pa.int32())), batch.column("at").take(pa.array(of, pa.int32())), key, cut, size]

    types = {"h": pa.binary(), "at": None, "key": pa.int64(), "cut": pa.int32(), "size": pa.int32()}
    variants = open_lines.mapInArrow(each(varied, types), f"h binary, at {PLACE}, key long, cut int, size int")
    variants = stored(variants, "variants")
    short, full = variants.filter("cut >= 0"), variants.filter("cut < 0")
    swapped = short.groupBy("key", "cut", "size").agg(F.min(F.struct("at", "h")).alias("b"), F.count("*").alias("n"))
    swapped = stored(swapped.filter("n > 1").selectExpr("key", "cut", "size", "b.h AS b"), "swapped")
    same = short.join(swapped, ["key", "cut", "size"]).select(F.col("h").alias("a"), "b")
    longer = short.join(full.selectExpr("h AS g", "at AS at_g", "key", "size"), ["key", "size"])
    longer = longer.selectExpr("CASE WHEN at < at_g THEN g ELSE h END AS a", "CASE WHEN at < at_g THEN h ELSE g END AS b")
    pairs = stored(same.unionAll(longer).filter("a <> b").distinct(), "pairs")
    read = pairs.join(lines.selectExpr("h AS a", "text AS s"), "a").join(lines.selectExpr("h AS b", "text AS t"), "b")
    return read.filter("levenshtein(s, t, 1) BETWEEN 0 AND 1").selectExpr("a AS h").distinct()


def repeated_lines(docs: DataFrame, least: int = 20, blocks: int = 4) -> DataFrame:
    """row, lines: the numbers of the lines of each row that repeat an earlier line.

    docs has doc_id, row, text. Earlier is by doc_id (missing ones last), row and
    line. Every line repeats the first line equal to it; the first one repeats
    a different line when that has an earlier first place and is one edit away. A
    line that drops out still counts as the earlier one for others.
    """
    lines = stored(_lines(docs, least), "lines")
    first = stored(lines.groupBy("h").agg(F.min(place()).alias("at"), F.count("*").alias("n")), "first")
    later = near_lines(docs, least, blocks)
    act = first.join(later.withColumn("near", F.lit(True)), "h", "left").filter("n > 1 OR near")
    act = stored(act.selectExpr("h AS of", "CASE WHEN near THEN NULL ELSE at END AS at"), "act")
    out = lines.join(act, F.expr("h = of")).filter("at IS NULL OR at.row <> row OR at.line <> line")
    return out.groupBy("row").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, least: int = 20, blocks: int = 4) -> DataFrame:
    """doc_id, n_lines, n_removed, text, and the other columns of docs.

    A line (\\n-split, ASCII white space trimmed) of at least `least` code points
    is removed when an earlier line of any document, itself included, is equal
    or one edit (a character put in, left out or changed) away. Documents in order
    of doc_id, missing ones last; shorter and blank lines stay. The lines that
    stay are joined by \\n as they were.

    Null text stays null and has no lines. Rows repeated in full are one document
    and get the same result; rows with one doc_id and different texts are ordered
    by a hash. An empty table gives an empty result. n_lines and n_removed replace
    columns of these names.
    """
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    gone = stored(repeated_lines(keyed, least, blocks).withColumnsRenamed({"row": "of", "lines": "gone"}), "gone")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    rows = docs.select(row.alias("row"), "text", F.struct("doc_id", *others).alias("rest"))
    joined = rows.join(gone, F.expr("row = of"), "left").select("rest", "gone", "text")
    split = joined.withColumn("lines", F.split("text", "\n"))
    return split.select(
        "rest.doc_id",
        F.expr("CAST(coalesce(size(lines), 0) AS BIGINT) AS n_lines"),
        F.expr("CAST(coalesce(size(gone), 0) AS BIGINT) AS n_removed"),
        F.expr(
            "CASE WHEN gone IS NULL THEN text ELSE array_join(filter(lines, (x, i) -> NOT array_contains(gone, i)), '\n') END AS text"
        ),
        *[F.col("rest").getField(c).alias(c) for c in others],
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, i) AS place,
         trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM lines),
first AS (SELECT t, length(t) AS n, min(place) AS place FROM numbered WHERE length(t) >= 20 GROUP BY t),
based AS (SELECT *, unnest([n, n - 1]) AS base FROM first),
halves AS (
  SELECT t, n, place, base, 'first' AS half, left(t, base // 2) AS same FROM based
  UNION ALL SELECT t, n, place, base, 'last', right(t, base - base // 2) FROM based),
pairs AS (
  SELECT DISTINCT a.t AS a, b.t AS b, a.n AS n, b.n AS m, a.place AS at_a, b.place AS at_b
  FROM halves a JOIN halves b ON a.base = b.base AND a.half = b.half AND a.same = b.same AND a.t <> b.t AND a.n <= b.n),
near AS (
  SELECT CASE WHEN at_a < at_b THEN b ELSE a END AS t
  FROM (SELECT *, unnest(generate_series(1, n + 1)) AS i FROM pairs)
  WHERE left(a, i - 1) = left(b, i - 1) AND ((n = m AND i <= n AND substr(a, i + 1) = substr(b, i + 1)) OR (n + 1 = m AND substr(a, i) = substr(b, i + 1)))),
judged AS (
  SELECT l.*, f.t IS NOT NULL AND (l.place > f.place OR l.t IN (SELECT t FROM near)) AS gone
  FROM numbered l LEFT JOIN first f ON f.t = l.t)
SELECT d.doc_id, count(j.i) AS n_lines, CAST(coalesce(sum(CAST(gone AS BIGINT)), 0) AS BIGINT) AS n_removed,
       CASE WHEN any_value(d.text) IS NOT NULL
            THEN sha256(coalesce(string_agg(raw, chr(10) ORDER BY j.i) FILTER (NOT gone), '')) END AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""
