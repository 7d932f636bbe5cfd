"""Quality rules whose cut-offs come from quantile sketches of the corpus itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytally.llm.common import BLANK, WORD, documents, stored

#: the ratios the adaptive rules look at, each with the slack added to its
#: fence, so that a ratio that hardly varies is not fenced in at its median; the one
#: of repeat_share is half the base rule's cut-off, so that its fence can be under it;
#: three repeated lines in ten are a usual cut-off for pages, here the least one
RATIOS = {"mean_word": 2.0, "symbol_share": 0.05, "dup_line_share": 0.3, "repeat_share": 0.1}
#: ratios that may be too small as well as too large
BOTH_ENDS = ("mean_word",)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.
    Lines are those with a word.

    Only built-in functions. Repeated five-word windows are found within the row:
    the windows' 64-bit hashes are sorted together with their positions, equal
    neighbours are the repeated windows, and each adds five words less what the
    next one covers too. Null text has no words and no lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = docs.select("doc_id", "lang", "source", text.alias("whole"), F.filter(F.split(text, BLANK), lambda w: w != "").alias("words"))
    windowed = worded.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("whole", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("whole", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.expr(
            "sort_array(transform(IF(size(words) < 5, array(), sequence(1, size(words) - 4)),"
            " i -> struct(xxhash64(slice(words, i, 5)) AS h, i AS i)))"
        ).alias("windows"),
    )
    found = windowed.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(windows, (x, k) -> x.h <=> get(windows, k - 1).h OR x.h <=> get(windows, k + 1).h), x -> x.i))"
        ),
    )
    covered = "aggregate(zip_with(places, slice(places, 2, size(places)), (a, b) -> least(5, coalesce(b - a, 5))), 0L, (n, x) -> n + x)"
    return found.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )


#: buckets of a sketch that one e-fold of a ratio is cut into: a bucket is 2% wide
PER_E = 50


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: a quantile sketch of every ratio for each language and
    source, as counts of logarithmic buckets; zeros have the lowest one.

    Sketches merge by adding counts, in whatever order, so the tasks' own ones are all
    that shuffles, a hot source costs nothing extra, and reruns give the same
    fences. A ratio has at most some thousand buckets.
    """
    rows = ", ".join(f"'{r}', {r}" for r in RATIOS)
    long = counted.selectExpr("lang", "source", f"stack({len(RATIOS)}, {rows}) AS (ratio, x)")
    bucket = f"CASE WHEN x > 0 THEN CAST(floor(ln(x) * {PER_E}) AS INT) ELSE -1000000 END AS bucket"
    return long.selectExpr("lang", "source", "ratio", bucket).groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, ratio, total, low and high quartile of each sketch: the middle of the bucket in
    which a quarter or three quarters of the documents are reached."""
    group = Window.partitionBy(*keys, "ratio")
    upto = group.orderBy("bucket")
    ranked = sketch.withColumns({"reached": F.sum("n").over(upto), "total": F.sum("n").over(group)})

    def value(quarters: int) -> str:
        bucket = f"min(CASE WHEN 4 * reached >= {quarters} * total THEN bucket END)"
        return f"CASE WHEN {bucket} = -1000000 THEN 0D ELSE exp(({bucket} + 0.5D) / {PER_E}) END"

    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), F.expr(value(1)).alias("low"), F.expr(value(3)).alias("high"))


def fences(counted: DataFrame, reach: float, least: int) -> DataFrame:
    """of_lang, of_source and the bounds `<ratio>_low`, `<ratio>_high` of every ratio.

    A source with under `least` documents says too little: it takes the sketch of its
    language, which is that of all its sources merged. A fence lies `reach`
    interquartile ranges beyond the quartiles, plus slack.
    """
    own = stored(sketches(counted), "sketches")
    merged = own.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = quartiles(merged, "lang").selectExpr("lang AS all_lang", "ratio AS all_ratio", "low AS all_low", "high AS all_high")
    both = quartiles(own, "lang", "source").join(whole, F.expr("lang <=> all_lang AND ratio = all_ratio"))
    chosen = both.selectExpr("lang", "source", "ratio", *[f"CASE WHEN total >= {least} THEN {q} ELSE all_{q} END AS {q}" for q in ("low", "high")])
    bounds = []
    for ratio, slack in RATIOS.items():
        low, high = (f"max(CASE WHEN ratio = '{ratio}' THEN {q} END)" for q in ("low", "high"))
        bounds.append(F.expr(f"{high} + {reach}D * ({high} - {low}) + {slack}D").alias(f"{ratio}_high"))
        bounds.append(F.expr(f"{low} - {reach}D * ({high} - {low}) - {slack}D").alias(f"{ratio}_low"))
    return chosen.groupBy("lang", "source").agg(*bounds).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})


def judge(docs: DataFrame, reach: float = 3.0, least: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rule that a document fails first.

    base_failed: under ten words, or over a fifth of the words in repeated
    five-word windows. Documents that pass are held against the fences of their
    language and source (`fences`), which follow the corpus instead of being
    fixed: characters per word, symbols per word, repeated lines per line, and the share
    of words in repeated windows. The fences come from the documents that pass the base
    rules; a language and source without any has no fence and is not filtered further.

    Null text has no words and fails the base rules. A null language or source
    is a value of its own. An empty table gives an empty result; rows repeated in
    full are each judged. Columns other than doc_id, text, lang, source are
    ignored. Quartiles are within 1% of exact ones, whatever the number of documents, and the
    same in every run. A text of any length is one row, worked on with built-in
    functions in memory of some 50 bytes a word.
    """
    n = F.greatest("n_words", F.lit(1))
    counted = stored(text_counts(docs), "counts").withColumns(
        {
            "base_failed": F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"),
            "mean_word": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
        }
    )
    cut = stored(fences(counted.filter("NOT base_failed"), reach, least), "fences")
    failed = F.when(F.col("base_failed"), "base")
    for ratio in RATIOS:
        failed = failed.when(F.col(ratio) > F.col(f"{ratio}_high"), f"{ratio}_high")
        if ratio in BOTH_ENDS:
            failed = failed.when(F.col(ratio) < F.col(f"{ratio}_low"), f"{ratio}_low")
    return counted.join(cut, F.expr("lang <=> of_lang AND source <=> of_source"), "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        failed.isNull().alias("kept"),
        failed.alias("failed_rule"),
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


ORACLE = r"""
WITH worded AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM worded WHERE len(w) > 4),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM placed),
repeated AS (
  SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS spot FROM windows WHERE n > 1) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(whole, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(whole, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
         CAST(len(list_filter(string_split(whole, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(whole, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM worded d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
shares AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) AS mean_word, n_symbols / greatest(n_words, 1) AS symbol_share,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share
  FROM counted),
long AS (  -- one bucket for every document and ratio
  SELECT lang, source, ratio, CASE WHEN x > 0 THEN CAST(floor(ln(x) * 50) AS INT) ELSE -1000000 END AS bucket
  FROM (SELECT lang, source, unnest(['mean_word', 'symbol_share', 'dup_line_share', 'repeat_share']) AS ratio,
               unnest([mean_word, symbol_share, dup_line_share, repeat_share]) AS x FROM shares WHERE NOT base_failed)),
own AS (SELECT lang, source, ratio, count(*) AS n, quantile_disc(bucket, [0.25, 0.75]) AS b FROM long GROUP BY lang, source, ratio),
whole_lang AS (SELECT lang, ratio, quantile_disc(bucket, [0.25, 0.75]) AS b FROM long GROUP BY lang, ratio),
chosen AS (
  SELECT o.lang, o.source, o.ratio, list_transform(CASE WHEN n >= 50 THEN o.b ELSE l.b END,
         lambda k: CASE WHEN k = -1000000 THEN 0::DOUBLE ELSE exp((k + 0.5::DOUBLE) / 50) END) AS q
  FROM own o JOIN whole_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.ratio = o.ratio),
cut AS (
  SELECT lang, source, max(q) FILTER (ratio = 'mean_word') AS m, max(q) FILTER (ratio = 'symbol_share') AS s,
         max(q) FILTER (ratio = 'dup_line_share') AS d, max(q) FILTER (ratio = 'repeat_share') AS r
  FROM chosen GROUP BY lang, source),
judged AS (
  SELECT x.*, CASE WHEN base_failed THEN 'base'
         WHEN mean_word > m[2] + 3 * (m[2] - m[1]) + 2 THEN 'mean_word_high'
         WHEN mean_word < m[1] - 3 * (m[2] - m[1]) - 2 THEN 'mean_word_low'
         WHEN symbol_share > s[2] + 3 * (s[2] - s[1]) + 0.05 THEN 'symbol_share_high'
         WHEN dup_line_share > d[2] + 3 * (d[2] - d[1]) + 0.3 THEN 'dup_line_share_high'
         WHEN repeat_share > r[2] + 3 * (r[2] - r[1]) + 0.1 THEN 'repeat_share_high' END AS failed_rule
  FROM shares x LEFT JOIN cut c ON c.lang IS NOT DISTINCT FROM x.lang AND c.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM judged
"""
