"""Properties of the physical plans."""

import re
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from daytally import session
from daytally.functions import windows as w
from daytally.operators import bundles, items
from daytally.plans import catalogue
from daytally.sources.transactions import roll_up_item_days, roll_up_store_days, sale_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# entries that act (write or count) while they are built
LAZY = sorted(set(catalogue.ENTRIES) - {"load_and_count", "load_delta"})


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_pair_forming_join(name, source):
    text = plan(catalogue.ENTRIES[name](source))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["store_ranking", "top_items_by_revenue", "like_for_like", "co_occurring"])
def test_window_and_columns_reach_the_scan(name, source):
    text = plan(catalogue.ENTRIES[name](source))
    scans = [s for s in text.split("FileScan parquet")[1:] if "lineitem" in s]
    assert scans
    for scan in scans:
        assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
        schema = scan.split("ReadSchema: struct<")[1]
        assert "l_linestatus" not in schema and "l_linenumber" not in schema


def test_revenue_only_reads_neither_orders_nor_counts(source):
    text = plan(source.store_days(None, ("total_net",)))
    assert "orders.parquet" not in text
    assert text.count("Exchange hashpartitioning") == 1
    schema = text.split("ReadSchema: struct<")[1]
    assert "l_orderkey" not in schema and "l_tax" not in schema


def test_roll_up_has_no_expand_and_shares_the_join_partitioning(source, spark):
    """Without broadcasting, one shuffle of lines serves join and first grouping."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, orders = sale_lines(source.table("lineitem")), source.table("orders")
        text = plan(roll_up_store_days(lines, orders))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "Expand" not in text
    # lines and headers by order; distinct customers; store-days
    assert text.count("Exchange hashpartitioning") == 4


def test_short_window_does_not_shuffle_all_order_headers(source, spark):
    """With large tables a Bloom filter of the window's orders prunes headers."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    keep = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert "might_contain" in plan(source.store_days(w.date_window("today", catalogue.AS_OF)))
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)


@pytest.fixture
def tiny_skew_limits(spark):
    """Broadcasts off, and limits at which small test data counts as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    keep = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in keep.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_store_day_in_a_bundle_is_split(spark, tiny_skew_limits):
    """A third of all item rows on one store-day: AQE splits the semi-join."""
    hot = spark.range(200_000).selectExpr(
        "id AS item_id",
        "CAST(if(id % 3 = 0, 1, id % 500 + 2) AS BIGINT) AS store_id",
        "date'2024-06-01' AS date",
        "CAST(2 AS DECIMAL(18,5)) AS total_quantity",
        "CAST(3 AS DECIMAL(18,5)) AS total_net",
    )
    names = spark.range(200_000).selectExpr("id", "concat('item ', id) AS description", "'x' AS pcode")
    df = bundles.co_occurring(hot, names, [0], (date(2024, 6, 1), date(2024, 6, 2)), k=None)
    got = df.collect()
    assert "skew=true" in plan(df)
    others = 200_000 // 3  # ids divisible by three, less the target
    assert len(got) == others and sum(r.co_occurrence_days for r in got) == others


def test_hot_item_is_split_where_its_cost_is_joined(spark, tiny_skew_limits):
    """A third of all lines belong to one item, over many stores and days; its
    partition is split although the next grouping is by item as well."""
    lines = spark.range(600_000).selectExpr(
        "id AS l_orderkey",
        "CAST(if(id % 3 = 0, 1, id % 4999 + 2) AS BIGINT) AS l_partkey",
        "id % 1009 AS l_suppkey",
        "'A' AS l_returnflag",
        "CAST(id % 50 + 1 AS DOUBLE) AS l_quantity",
        "CAST(hash(id) % 100000 + 100001 AS DOUBLE) AS l_extendedprice",
        "0D AS l_discount",
        "0D AS l_tax",
        "CAST(date_add(date'2024-01-01', CAST(id % 365 AS INT)) AS TIMESTAMP_NTZ) AS l_shipdate",
    )
    part = spark.range(6000).selectExpr("id AS p_partkey", "3D AS p_retailprice")
    names = spark.range(6000).selectExpr("id", "concat('item ', id) AS description", "'x' AS pcode")
    df = items.low_margin_items(roll_up_item_days(sale_lines(lines), part), names, date(2024, 12, 31), days=400, below=2)
    got = df.collect()
    assert "skew=true" in plan(df)
    assert sum(r.qtd_vendida for r in got) == sum(n % 50 + 1 for n in range(600_000))


def test_top_k_is_not_a_global_sort(source):
    text = plan(catalogue.ENTRIES["top_items_by_margin"](source))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_dimensions_are_broadcast_by_size_only(source, spark):
    entry = catalogue.ENTRIES["ytd_by_store"]
    assert "BroadcastHashJoin" in plan(entry(source))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(entry(source))
        want = sorted(map(tuple, entry(source).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert want == sorted(map(tuple, entry(source).collect()))


def test_joined_rows_are_summed_first(source):
    """The item list meets one row per item: the aggregate is below the join."""
    text = plan(catalogue.ENTRIES["loss_items"](source))
    joined = [line for line in text.splitlines() if re.search(r"HashJoin|SortMergeJoin", line)]
    assert len(joined) >= 1
    top = next(k for k, line in enumerate(text.splitlines()) if re.search(r"HashJoin|SortMergeJoin", line))
    below = "\n".join(text.splitlines()[top:])
    above = "\n".join(text.splitlines()[:top])
    assert "HashAggregate" in below and "HashAggregate" not in above


def skewed_lines(spark, n=60_000):
    """Sales lines of which a third belong to one store, item, day and order."""
    hot = F.col("id") % 3 == 0
    pick = lambda value, other: F.when(hot, F.lit(value)).otherwise(other)
    return spark.range(n).select(
        pick(1, F.col("id") % 997 + 2).cast("bigint").alias("l_orderkey"),
        pick(1, F.col("id") % 89 + 2).cast("bigint").alias("l_partkey"),
        pick(1, F.col("id") % 13 + 2).cast("bigint").alias("l_suppkey"),
        F.expr("if(id % 5 = 0, 'R', 'A')").alias("l_returnflag"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        (F.col("id") % 1000 + 0.25).cast("double").alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"),
        F.lit(0.2).alias("l_tax"),
        F.expr("cast(if(id % 3 = 0, date'2024-06-01', date_add(date'2024-06-01', cast(id % 30 as int))) as timestamp_ntz)").alias("l_shipdate"),
    )


def test_hot_store_day_and_hot_order(spark):
    """A hot group is summed before it is shuffled, and sums stay whole."""
    lines = skewed_lines(spark)
    orders = spark.range(1, 1000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"))
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = roll_up_store_days(sale_lines(lines), orders).collect()
        hot = [r for r in got if r.store_id == 1]
        assert len(hot) == 1 and hot[0].nr_sales == 1 and hot[0].nr_persons == 1
        assert sum(r.total_quantity for r in got) == sum(n % 50 + 1 for n in range(60_000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


@pytest.mark.parametrize("name", ["top_items_by_revenue_newest", "newest_facts"])
def test_moving_window_reaches_the_scan(name, source):
    """The bounds come from the date column alone, and the scan filters on them."""
    df = catalogue.ENTRIES[name](source)
    df.collect()
    text = plan(df)
    assert re.search(r"GreaterThanOrEqual\(l_shipdate,|l_shipdate#\d+ >= (Reused)?[sS]ubquery", text)
    assert re.search(r"ReadSchema: struct<l_shipdate:\w+>", text)


def test_yoy_by_store_reads_two_years(source):
    text = plan(catalogue.ENTRIES["yoy_by_store"](source))
    scans = [x for x in text.split("FileScan")[1:] if "l_extendedprice" in x.splitlines()[0]]
    assert len(scans) == 1 and "GreaterThanOrEqual(l_shipdate,2000-01-01" in scans[0]


def test_shuffles_are_sized_by_input(spark, source):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    df = source.item_days()
    session.size_shuffles(spark, df)
    assert spark.conf.get("spark.sql.shuffle.partitions") == keep
    session.size_shuffles(spark, df, bytes_per_partition=1)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 100_000  # no cap
    session.size_shuffles(spark, source.stores)
    assert spark.conf.get("spark.sql.shuffle.partitions") == keep


def test_invariants(source):
    """Per-store sums add up to the total; store-day totals equal daily sums."""
    day = catalogue.AS_OF
    per_store = catalogue.ENTRIES["sales_on_day_any_status"](source).agg(F.sum("vendas_sem_iva")).first()[0]
    assert per_store == catalogue.ENTRIES["day_total"](source).first()[0]
    months = catalogue.ENTRIES["monthly_sales_of_year"](source).agg(F.sum("receita_total")).first()[0]
    year = catalogue.ENTRIES["annual_by_store"](source).filter("ano = 2000").agg(F.sum("vendas_anuais")).first()[0]
    assert months == year
    for r in catalogue.ENTRIES["yoy_monthly"](source).collect():
        assert r.diferenca == (r.vendas_ano - r.vendas_ano_anterior).quantize(Decimal("0.01"), ROUND_HALF_UP)
    assert w.date_window("today", day) == (day, date(2001, 7, 1))


def test_seasonal_bundles_equal_brute_force(source):
    """Bit counting against plain Python over all store-days."""
    window = catalogue.SUMMER
    sales = source.item_days(window, ("total_quantity", "total_net")).filter("total_quantity > 0")
    targets = bundles.seasonal_items(source.item_days(catalogue.HISTORY, ("total_quantity", "total_net")), source.items, catalogue.HISTORY)
    target_ids = {r.item_id for r in targets.collect()}
    baskets = {}
    for r in sales.collect():
        baskets.setdefault((r.store_id, r.date), set()).add(r.item_id)
    names = {r.id: r.description for r in source.items.collect()}
    want = {}
    for basket in baskets.values():
        for t in basket & target_ids:
            for p in basket - {t}:
                want[names[t], names[p]] = want.get((names[t], names[p]), 0) + 1
    got = bundles.bundles_per_target(sales, source.items, targets, window).collect()
    assert {(r.artigo, r.parceiro): r.co_occurrence_days for r in got} == want


def test_bytes_of_a_task_are_bounded(spark):
    """Half a gigabyte is read and shuffled in pieces small enough to be sorted in memory."""
    keys = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    keep = {key: spark.conf.get(key) for key in keys}
    try:
        for given, put in (("128MB", 16 << 20), ("64m", 16 << 20), ("1m", "1m"), ("300000", "300000"), ("1g", 16 << 20)):
            for key in keys:
                spark.conf.set(key, given)
            session.tune(spark)
            assert [spark.conf.get(key) for key in keys] == [str(put)] * 2
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)


def test_shuffle_partitions_follow_the_bytes_read(spark, source):
    """A tenth of a gigabyte, whatever the session's own number."""
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    big = spark.range(100 << 20 >> 3)  # eight bytes a row
    session.size_shuffles(spark, big)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 6
    session.size_shuffles(spark, source.stores)
    assert spark.conf.get("spark.sql.shuffle.partitions") == keep
