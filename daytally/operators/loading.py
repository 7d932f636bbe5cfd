"""The load job: route by date range, write beside what is live, check keys, make live."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytally import session
from daytally.schemas import KEYS, LAYOUTS, Layout
from daytally.session import in_ranges_of
from daytally.sources.versions import Change, Stored, read, typed

# How a fact table is written:
#   merge - rows are put in by key: a key already stored is replaced, all other
#           stored rows stay; running a load twice changes nothing
#   append - rows are added; a key that is already stored stops the load
#   replace_directories - the year or month directories that the data touches
#           hold afterwards what the data holds for them, and nothing else
#   replace - the whole table is dropped and written again
MODES = ("merge", "append", "replace_directories", "replace")


class DuplicateKeyError(ValueError):
    """Rows to be loaded repeat a key, among themselves or one that is stored."""


class OutOfRangeError(ValueError):
    """Rows to be loaded have dates that no range takes."""


@dataclass(frozen=True)
class Routed:
    accepted: DataFrame
    rejected: DataFrame


def size_shuffles(spark: SparkSession, df: DataFrame) -> None:
    """One shuffle partition for 8 MB read: a task of a load groups rows by order and by day
    and sorts them for its files, all of which is held at once."""
    session.size_shuffles(spark, df, 8 << 20)


def route(facts: DataFrame, layout: Layout) -> Routed:
    """Split facts into rows some date range takes and rows no range takes."""
    takes = layout.accepts(F.col("date"))
    return Routed(facts.filter(takes), facts.filter(~takes))


def partition_sizes(facts: DataFrame, layout: Layout) -> DataFrame:
    """Rows per date range; rows without a range under a NULL partition."""
    return (
        facts.groupBy(layout.partition_name(F.col("date")).alias("partition"))
        .agg(F.count("*").alias("registos"), F.min("date").alias("primeira"), F.max("date").alias("ultima"))
        .orderBy("partition")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("linhas")).filter(F.col("linhas") > 1)


def require_unique(df: DataFrame, keys: list[str], table: str) -> None:
    """Stop the load when a key is NULL or occurs twice."""
    some_null = F.lit(False)
    for key in keys:
        some_null = some_null | F.col(key).isNull()
    bad = df.groupBy(*keys).agg(F.count("*").alias("linhas")).filter((F.col("linhas") > 1) | some_null).head(1)
    if bad:
        raise DuplicateKeyError(f"{table}: key {bad[0].asDict()}")


def put_dimension(change: Change, df: DataFrame, table: str) -> None:
    change.write(table, typed(df, table), KEYS[table], anew=True)


def write_dimension(df: DataFrame, root: str, table: str) -> None:
    """Replace a dimension of the lake below root."""
    require_unique(df, KEYS[table], table)
    with Change(df.sparkSession, root) as change:
        put_dimension(change, df, table)


def dated(facts: DataFrame, layout: Layout) -> DataFrame:
    """Facts with the columns of their directories."""
    df = facts.withColumn("year", F.year("date"))
    return df.withColumn("month", F.month("date")) if layout.unit == "month" else df


def within(df: DataFrame, rows: DataFrame) -> tuple[Column, Column]:
    """Conditions on df: dated between the first and the last day of rows, or not."""
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    inside = F.coalesce(F.col("date").between(first, last), F.lit(False))
    return inside, ~inside


def put_facts(
    change: Change, df: DataFrame, layout: Layout, mode: str = "merge", check: bool = False, laid_out: bool = False
) -> None:
    """Write facts into year or year/month directories, in one of MODES, and stop the load
    when keys repeat: among the rows (if they are to be checked) or, in append mode,
    with stored ones.

    The rows are computed once, into directories of their own; keys are checked on what
    is written, and only stored directories of the same years or months are read. Of
    those, rows outside the delivered days go to their new files as they lie, without
    a join or a shuffle. Stored columns that a delivery does not have stay, and are NULL in its
    rows; a row that is delivered again replaces the stored one in all columns.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    table, keys, parts = layout.table, KEYS[layout.table], tuple(layout.columns)
    order = [keys[0], "date"]
    size_shuffles(df.sparkSession, df)
    rows = dated(typed(df, table), layout)
    laid_out = laid_out or in_ranges_of(rows, "date")
    new = change.write(table, rows, order, parts, anew=mode == "replace", laid_out=laid_out)
    rows, touched = change.read(table, new), change.touched(table, new)
    if check:
        require_unique(rows, keys, table)
    if mode == "replace_directories":
        change.retire(table, touched)
    elif touched:
        held = change.read(table, touched)
        inside, outside = within(held, rows)
        if mode == "append":
            twice = held.filter(inside).select(*keys).join(rows.select(*keys), keys, "left_semi").head(1)
            if twice:
                raise DuplicateKeyError(f"{table}: key {twice[0].asDict()} is stored already")
        else:
            kept = held.filter(inside).join(rows.select(*keys), keys, "left_anti").hint("rebalance", *parts)
            change.write(table, held.filter(outside).unionByName(kept), order, parts, touched, laid_out=True)


def write_facts(df: DataFrame, root: str, layout: Layout, mode: str = "merge", check: bool = True) -> None:
    """Check facts and write them to the lake below root, in one of MODES."""
    with Change(df.sparkSession, root) as change:
        put_facts(change, df, layout, mode, check)


def put_rejected(change: Change, df: DataFrame, table: str, mode: str) -> None:
    """Keep rows without a date range, by key, so that a load that is run again adds nothing.
    They come from files or a join by key, so they are written as they lie."""
    name, rows = f"rejected_{table}", typed(df, table)
    if mode != "replace" and name in change.tables:
        same = [F.col(f"held.{k}").eqNullSafe(F.col(f"new.{k}")) for k in KEYS[table]]
        old = change.read(name).alias("held").join(rows.alias("new"), reduce(Column.__and__, same), "left_anti")
        rows = rows.unionByName(old, allowMissingColumns=True)
    held = change.stored(name).directories
    change.write(name, rows, KEYS[table], replaces=held, anew=mode == "replace", laid_out=True)


def load(
    source, root: str, layouts: dict[str, Layout] | None = None, mode: str = "merge", rejects: str = "stop"
) -> dict[str, DataFrame]:
    """Load dimensions and facts of a source into the lake below root, all or nothing.

    Rows that no date range takes are looked for first; they stop the load or, with
    rejects="keep", go to the lake's tables rejected_<table>, by key. The others are computed
    once, into the directories they will lie in, and their keys are checked there. The
    new directories of all tables become live in one step
    (`daytally.sources.versions`); a load that fails, at whatever point, leaves the lake as
    it was and can be run again. Returns the rejected rows the lake holds for each fact
    table. A source that can give its facts in ranges of days (`by_day`) is asked to.

    Keys of rolled-up facts are unique by construction (they are grouping keys) and are
    not checked again; stored keys are, in the modes where they matter.
    A source that has nothing for a fact table (`None`) leaves it as it is.
    """
    if rejects not in ("stop", "keep"):
        raise ValueError("rejects is stop or keep")
    spark, layouts = source.spark, layouts or LAYOUTS
    dimensions = {"stores": source.located_stores, "items": source.items}
    dealt = getattr(source, "by_day", source)
    facts = {"da_stores_date": dealt.store_days(), "da_items_stores_date": dealt.item_days()}
    facts = {table: df for table, df in facts.items() if df is not None}
    with Change(spark, root) as change:
        for table, df in dimensions.items():
            require_unique(df, KEYS[table], table)
        routed, out = {}, {}
        for table, df in facts.items():
            size_shuffles(spark, df)
            split = route(df, layouts[table])
            routed[table] = Routed(split.accepted, change.staged(split.rejected, table))
            out[table] = routed[table].rejected.count()
            if out[table] and rejects == "stop":
                raise OutOfRangeError(f"{table}: {out[table]} rows have dates that no range takes")
        for table, df in dimensions.items():
            put_dimension(change, df, table)
        for table in facts:
            put_facts(change, routed[table].accepted, layouts[table], mode, check=not source.keys_are_grouped)
            if out[table] or mode == "replace" and f"rejected_{table}" in change.tables:
                put_rejected(change, routed[table].rejected, table, mode)
        tables = change.tables
    held = {table: tables.get(f"rejected_{table}", Stored(tuple(df.columns))) for table, df in facts.items()}
    return {table: read(spark, root, f"rejected_{table}", stored) for table, stored in held.items()}


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Export a result as CSV files with a header, compressed if asked for (`gzip`)."""
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
