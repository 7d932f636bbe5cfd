"""Checks on loaded tables, and small views of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, also as a text line."""
    parts = [df.agg(F.count("*").alias("linhas")).select(F.lit(name).alias("tabela"), "linhas") for name, df in tables.items()]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts.withColumn("texto", F.concat_ws(": ", "tabela", F.col("linhas").cast("string")))


def key_counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows and distinct keys per table; they differ where a key is repeated."""
    parts = [
        df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"), F.count("*").alias("chaves"))
        .select(F.lit(name).alias("tabela"), "linhas", "chaves")
        for name, (df, keys) in tables.items()
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts


def load_delta(rows_before: int, facts: DataFrame) -> DataFrame:
    """Rows before and after a load, and the dates now covered."""
    return facts.agg(
        F.lit(rows_before).cast("bigint").alias("linhas_antes"),
        F.count("*").alias("linhas_depois"),
        (F.count("*") - F.lit(rows_before).cast("bigint")).alias("importadas"),
        F.min("date").alias("primeira"),
        F.max("date").alias("ultima"),
    )


def load_progress(facts: DataFrame, expected_rows: int) -> DataFrame:
    """Share of the expected rows that is loaded, in whole percent."""
    done = F.floor(F.count("*") * F.lit(100).cast("bigint") / F.lit(expected_rows)).cast("bigint")
    return facts.agg(
        F.count("*").alias("linhas"), F.min("date").alias("primeira"), F.max("date").alias("ultima"), done.alias("percent")
    )


def coverage(facts: DataFrame) -> DataFrame:
    """Rows per year and month."""
    return (
        facts.groupBy(F.year("date").alias("ano"), F.month("date").alias("mes"))
        .agg(F.count("*").alias("registos"))
        .orderBy("ano", "mes")
    )


def missing_days(facts: DataFrame) -> DataFrame:
    """Days between the first and last fact date without any fact."""
    days = facts.groupBy("date").agg(F.lit(1).alias("seen"))
    bounds = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).filter("lo is not null")
    every_day = bounds.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return every_day.join(days, "date", "left_anti").orderBy("date")


def missing_ranges(facts: DataFrame) -> DataFrame:
    """Runs of days without a fact, per store, between its first and last day.

    Each day looks at the next one of its store, so no calendar is built per
    store; a store has at most one row per day in the window.
    """
    days = facts.select("store_id", "date").distinct()
    following = F.lead("date").over(W.partitionBy("store_id").orderBy("date"))
    return (
        days.withColumn("next", following)
        .filter(F.datediff("next", "date") > 1)
        .select(
            "store_id",
            F.date_add("date", 1).alias("de"),
            F.date_sub("next", 1).alias("ate"),
            (F.datediff("next", "date") - 1).alias("dias"),
        )
    )


def data_context(store_days: DataFrame, stores: DataFrame, items: DataFrame) -> DataFrame:
    """One row: dates covered, active stores, active products."""
    active = F.col("status") == 1
    dates = store_days.agg(F.min("date").alias("data_inicial"), F.max("date").alias("data_final"))
    n_stores = stores.filter(active).agg(F.count("*")).scalar()
    n_items = items.filter(active).agg(F.count("*")).scalar()
    return dates.select("*", n_stores.alias("lojas_ativas"), n_items.alias("artigos_ativos"))


def active_stores(stores: DataFrame) -> DataFrame:
    return stores.filter("status = 1").select("id", "name").orderBy("name", "id")


def store_list(stores: DataFrame) -> DataFrame:
    """All stores, as shown after a load."""
    return stores.select("id", "name", "code").orderBy("id")


def capped(df: DataFrame, order: list[Column | str], n: int = 200) -> DataFrame:
    """The first n rows, each with the size of the whole result and a note when
    it was cut."""
    total = df.agg(F.count("*")).scalar()
    shown = F.lit(f"Showing first {n} of ")
    return (
        df.orderBy(*order)
        .limit(n)
        .withColumn("total_rows", total)
        .withColumn("note", F.when(F.col("total_rows") > n, F.concat(shown, F.col("total_rows").cast("string"), F.lit(" rows."))))
    )


def newest(facts: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The k newest facts; equal dates in key order.

    Every date has a fact at least, so the source need only be asked for the facts
    of its k newest dates (`newest_dates`).
    """
    return facts.orderBy(F.desc("date"), *keys).limit(k)


def sample_rows(df: DataFrame, key: str = "id", k: int = 5) -> DataFrame:
    return df.orderBy(key).limit(k)


def plain_values(df: DataFrame) -> DataFrame:
    """Result values as plain types: dates as ISO text, every number a double."""

    def plain(field) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(field.name)
        if isinstance(field.dataType, NumericType):
            return c.cast("double").alias(field.name)
        return c

    return df.select(*[plain(field) for field in df.schema.fields])
