"""The load job on a fresh folder, and analyses over what it wrote."""

import re
from datetime import date
from decimal import Decimal

import pytest
from helpers import item_days, items, rows, store_days, stores
from pyspark.sql import functions as F

from daytally import session
from daytally.functions import windows as w
from daytally.operators import checks, loading
from daytally.plans import catalogue
from daytally.schemas import ITEM_DAYS, ITEMS, LAYOUTS, STORE_DAYS, STORES, Layout
from daytally.session import in_ranges_of
from daytally.sources.lake import Lake
from daytally.sources.landing import Landing, read_if_there, read_typed
from daytally.sources.versions import Change, ConcurrentLoadError, typed, vacuum

WIDE = {
    "da_stores_date": Layout("da_stores_date", "year", 1996, 2010),
    "da_items_stores_date": Layout("da_items_stores_date", "month", 1996, 2010),
}


@pytest.fixture(scope="module")
def lake(source, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    rejected = loading.load(source, root, WIDE, mode="replace")
    assert all(df.count() == 0 for df in rejected.values())
    return Lake(source.spark, root)


def test_schemas_have_the_source_columns():
    assert [len(s) for s in (STORES, ITEMS, STORE_DAYS, ITEM_DAYS)] == [53, 56, 19, 10]


@pytest.mark.parametrize(
    "name",
    [
        "sales_on_day",
        "period_by_store",
        "yoy_monthly",
        "store_ranking",
        "top_items_by_revenue",
        "top_items_by_revenue_newest",
        "loss_items",
        "like_for_like",
        "co_occurring",
        "seasonal_items",
        "coverage",
        "data_context",
        "event_impact",
        "plain_values",
        "capped_result",
        "newest_facts",
        "yoy_by_store",
        "facts_per_item_day",
        "bundles_per_seasonal_item",
    ],
)
def test_lake_gives_the_same_results(name, lake, source):
    run = catalogue.ENTRIES[name]
    want = catalogue.comparable_types(run(source))
    got = catalogue.comparable_types(run(lake))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_newest_date(lake, source):
    assert lake.newest_date() == source.item_days(None, ("total_net",)).agg(F.max("date")).first()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_window_prunes_directories(lake):
    df = lake.item_days((date(2000, 11, 20), date(2001, 2, 10)), ("total_net",))
    months = {(r.date.year, r.date.month) for r in df.select("date").distinct().collect()}
    assert months == {(2000, 11), (2000, 12), (2001, 1), (2001, 2)}
    text = plan(df)
    assert "year" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date,2000-11-20)" in text
    files = {f.split("/da_items_stores_date/")[1].rsplit("/", 1)[0] for f in lake.table("da_items_stores_date").inputFiles()}
    assert len(files) > 60 and all("month=" in f for f in files)


@pytest.mark.parametrize("name", ["top_items_by_revenue_newest", "newest_facts", "yoy_by_store"])
def test_moving_windows_skip_directories(name, lake):
    parts = plan(catalogue.ENTRIES[name](lake)).split("PartitionFilters: [")[1:]
    assert any("year" in part.split("]")[0] for part in parts)


def test_window_inside_one_year_and_over_new_year(spark):
    days = spark.sql(
        "select date, year(date) year, month(date) month from (select explode(sequence(date'1999-01-01', date'2002-12-31')) date)"
    )
    for window in [
        (date(2000, 3, 5), date(2000, 3, 6)),
        (date(2000, 12, 31), date(2001, 1, 1)),
        (date(2000, 12, 31), date(2001, 1, 2)),
        (date(1999, 11, 3), date(2002, 2, 7)),
    ]:
        assert w.clip(days, window).count() == (window[1] - window[0]).days


def written(root):
    """Data files below a lake's folder."""
    return sorted(root.rglob("*.parquet"))


def facts(spark, *days, net=10):
    return store_days(spark, *[(1, day, net) for day in days])


def stored(spark, root):
    return sorted(rows(Lake(spark, root).store_days(), "date", "total_net"))


def test_merge_keeps_stored_rows(spark, tmp_path):
    """One-day increments inside one year directory."""
    path, layout = str(tmp_path / "f"), LAYOUTS["da_stores_date"]
    loading.write_facts(facts(spark, "2023-05-01", "2024-01-05", "2024-03-01", "2024-05-01"), path, layout, "replace")
    for _ in range(2):
        loading.write_facts(facts(spark, "2024-05-02", net=20), path, layout)
    loading.write_facts(facts(spark, "2024-03-01", net=30), path, layout, "merge")
    assert stored(spark, path) == [
        (date(2023, 5, 1), 10),
        (date(2024, 1, 5), 10),
        (date(2024, 3, 1), 30),
        (date(2024, 5, 1), 10),
        (date(2024, 5, 2), 20),
    ]
    loading.write_facts(facts(spark, "2024-06-01"), path, layout, "replace_directories")
    assert stored(spark, path) == [(date(2023, 5, 1), 10), (date(2024, 6, 1), 10)]
    loading.write_facts(facts(spark, "2024-06-01"), path, layout, "replace")
    assert len(stored(spark, path)) == 1
    with pytest.raises(ValueError):
        loading.write_facts(facts(spark, "2024-06-01"), path, layout, "upsert")


def test_append_refuses_stored_keys(spark, tmp_path):
    path, layout = str(tmp_path / "f"), LAYOUTS["da_stores_date"]
    loading.write_facts(facts(spark, "2024-05-01"), path, layout, "append")
    loading.write_facts(facts(spark, "2024-05-02"), path, layout, "append")
    with pytest.raises(loading.DuplicateKeyError):
        loading.write_facts(facts(spark, "2024-05-02", "2024-05-03"), path, layout, "append")
    assert [d.day for d, _ in stored(spark, path)] == [1, 2]


class Delivery:
    keys_are_grouped = False

    def __init__(self, spark, store_rows, item_rows):
        self.spark, self._facts = spark, (store_rows, item_rows)
        self.located_stores, self.items = stores(spark, (1, "a", 1)), items(spark, 1)

    def store_days(self):
        return self._facts[0]

    def item_days(self):
        return self._facts[1]


def test_out_of_range_rows_stop_the_load_or_are_kept(spark, tmp_path):
    root = str(tmp_path / "lake")
    late = Delivery(spark, facts(spark, "2024-05-01", "2027-01-01"), None)
    with pytest.raises(loading.OutOfRangeError, match="1 rows"):
        loading.load(late, root)
    assert Lake(spark, root).version().tables == {} and written(tmp_path / "lake") == []
    for _ in range(2):  # running a load again keeps the same rejects once
        rejected = loading.load(late, root, rejects="keep")
        assert rows(rejected["da_stores_date"], "date") == [(date(2027, 1, 1),)]
    assert Lake(spark, root).table("rejected_da_stores_date").count() == 1
    assert Lake(spark, root).store_days().count() == 1
    assert list((tmp_path / "lake" / "_staging").iterdir()) == []


def test_rejects_are_written_as_they_lie(spark, tmp_path, monkeypatch):
    laid_out, write = {}, Change.write

    def writing(self, name, *args, **more):
        laid_out[name] = more.get("laid_out", False)
        return write(self, name, *args, **more)

    monkeypatch.setattr(Change, "write", writing)
    late = Delivery(spark, facts(spark, "2024-05-01", "2027-01-01", "2027-01-02"), None)
    for mode in ("replace", "merge"):
        rejected = loading.load(late, str(tmp_path / "lake"), mode=mode, rejects="keep")
        assert sorted(rows(rejected["da_stores_date"], "date")) == [(date(2027, 1, 1),), (date(2027, 1, 2),)]
        assert laid_out["rejected_da_stores_date"]


def test_load_sizes_its_shuffles(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(loading, "size_shuffles", lambda s, df: seen.append(df.columns))
    loading.load(Delivery(spark, facts(spark, "2024-05-01"), None), str(tmp_path / "lake"))
    assert seen and all("total_net" in columns for columns in seen)


def test_duplicate_or_missing_key_stops_the_load(spark, tmp_path):
    g = item_days(spark, (1, 1, "2024-06-01", 1, 1, 1), (1, 1, "2024-06-01", 2, 1, 1))
    layout = LAYOUTS["da_items_stores_date"]
    with pytest.raises(loading.DuplicateKeyError):
        loading.write_facts(g, str(tmp_path / "g"), layout)
    assert written(tmp_path / "g") == []
    keyless = g.limit(1).withColumn("store_id", F.lit(None).cast("bigint"))
    with pytest.raises(loading.DuplicateKeyError):
        loading.write_facts(keyless, str(tmp_path / "g"), layout)
    with pytest.raises(loading.DuplicateKeyError):
        loading.write_dimension(stores(spark, (1, "a", 1), (1, "b", 1)), str(tmp_path / "s"), "stores")


def test_hot_directory_is_rebalanced(spark, tmp_path):
    """Nine in ten rows in one month: the write spreads them over tasks."""
    g = spark.range(200_000).select(
        F.col("id").alias("item_id"),
        F.lit(1).cast("bigint").alias("store_id"),
        F.when(F.col("id") % 10 == 0, F.lit(date(2024, 1, 1))).otherwise(F.lit(date(2024, 6, 1))).alias("date"),
        F.lit(1).cast("decimal(18,5)").alias("total_quantity"),
    )
    keep = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        loading.write_facts(g, str(tmp_path / "hot"), LAYOUTS["da_items_stores_date"], "replace", check=False)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", keep)
    hot = list((tmp_path / "hot" / "da_items_stores_date").glob("load=*/year=2024/month=6/*.parquet"))
    assert len(hot) > 1
    assert Lake(spark, str(tmp_path / "hot")).item_days().count() == 200_000


def landed(spark, folder, df, table):
    """df as a CSV delivery, with its columns in reverse."""
    loading.write_csv(df.select(*reversed(df.columns)), str(folder / table))


def test_landing_folder_to_stored_tables(spark, tmp_path, caplog):
    files, root = tmp_path / "files", str(tmp_path / "lake")
    landed(spark, files, stores(spark, (1, "a", 1), (2, "b", 1)), "stores")
    landed(spark, files, items(spark, 1), "items")
    landed(spark, files, store_days(spark, (1, "2024-06-01", 12.5)), "da_stores_date_2024")
    landed(spark, files, store_days(spark, (2, "2023-06-01", 7)), "da_stores_date_2023")
    source = Landing(spark, str(files), "csv")
    assert loading.load(source, root).keys() == {"da_stores_date"}
    assert "nothing to load for da_items_stores_date" in caplog.text
    lake = Lake(spark, root)
    assert sorted(rows(lake.store_days(), "store_id", "total_net", "total_doc")) == [(1, Decimal("12.5"), 15), (2, 7, Decimal("8.4"))]
    assert lake.stores.count() == 2
    # a misspelt path replaces nothing
    with pytest.raises(Exception):
        loading.load(Landing(spark, str(tmp_path / "flies"), "csv"), root)
    assert lake.stores.count() == 2 and lake.store_days().count() == 2


def test_missing_fact_files_are_a_warning(spark, tmp_path, caplog):
    assert read_if_there(spark, "da_stores_date", str(tmp_path / "nothing*")) is None
    assert "nothing to load" in caplog.text
    with pytest.raises(Exception):
        read_typed(spark, "stores", str(tmp_path / "nothing"))


def test_unknown_csv_column_is_an_error(spark, tmp_path):
    loading.write_csv(store_days(spark, (1, "2024-06-01", 1)).withColumnRenamed("total_net", "net"), str(tmp_path / "f"))
    with pytest.raises(ValueError, match="net"):
        read_typed(spark, "da_stores_date", str(tmp_path / "f"), "csv")


def test_csv_landing_and_export(spark, tmp_path):
    landed = store_days(spark, (1, "2024-06-01", 12.5), (2, "2024-06-01", 7))
    full = landed.select(*[F.col(f.name) if f.name in landed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STORE_DAYS])
    loading.write_csv(full, str(tmp_path / "csv"))
    back = read_typed(spark, "da_stores_date", str(tmp_path / "csv"), "csv")
    assert back.schema == STORE_DAYS
    assert sorted(rows(back, "store_id", "total_net", "last_sale")) == [(1, Decimal("12.5"), None), (2, 7, None)]
    (tmp_path / "bad.csv").write_text(",".join(f.name for f in STORE_DAYS) + "\nx" + "," * 18 + "\n")
    with pytest.raises(Exception):
        read_typed(spark, "da_stores_date", str(tmp_path / "bad.csv"), "csv").collect()


def test_narrower_parquet_reads_under_the_schema(spark, tmp_path):
    narrow = spark.sql(
        "select cast(7 as int) store_id, date'2024-06-01' date, cast(3 as int) nr_sales, cast(12.5 as decimal(15,5)) total_net"
    )
    narrow.write.parquet(str(tmp_path / "narrow"))
    row = read_typed(spark, "da_stores_date", str(tmp_path / "narrow")).first()
    assert (row.store_id, row.nr_sales, row.total_net, row.last_sale) == (7, 3, Decimal("12.5"), None)


def test_counts_progress_and_delta(spark):
    f = facts(spark, "2024-05-01", "2024-05-02", "2024-05-03")
    i = items(spark, 1, 2)
    assert rows(checks.row_counts({"items": i, "facts": f}), "texto") == [("items: 2",), ("facts: 3",)]
    assert rows(checks.load_progress(f, 7), "percent") == [(42,)]
    assert rows(checks.load_delta(1, f)) == [(1, 3, 2, date(2024, 5, 1), date(2024, 5, 3))]


# --- all or nothing ---


class Broken(Delivery):
    """Item facts of which one row fails when it is computed."""

    def item_days(self):
        return self._facts[1].withColumn("total_net", F.expr("CASE WHEN item_id = 3 THEN raise_error('bad row') ELSE total_net END"))


def contents(root, spark):
    lake = Lake(spark, root)
    return {name: sorted(map(tuple, lake.table(name).collect()), key=repr) for name in lake.version().tables}


def first_load(spark, root):
    i = item_days(spark, (1, 1, "2023-05-01", 1, 10, 4), (1, 1, "2024-05-01", 1, 10, 4), (3, 1, "2024-06-01", 2, 9, 4))
    loading.load(Delivery(spark, facts(spark, "2023-05-01", "2024-05-01"), i), root)
    return i


def test_a_failing_task_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "lake")
    i = first_load(spark, root)
    before, files = contents(root, spark), written(tmp_path)
    with pytest.raises(Exception, match="bad row"):
        loading.load(Broken(spark, facts(spark, "2024-05-01", "2025-01-01", net=70), i), root)
    assert contents(root, spark) == before and written(tmp_path) == files
    assert list((tmp_path / "lake" / "_staging").iterdir()) == []


@pytest.mark.parametrize("mode", loading.MODES)
@pytest.mark.parametrize("after", [1, 2, 3])
def test_an_error_between_two_writes_changes_nothing(spark, tmp_path, monkeypatch, mode, after):
    """Dimensions and one fact table are written, the next write fails."""
    root = str(tmp_path / "lake")
    first_load(spark, root)
    before, files = contents(root, spark), written(tmp_path)
    write, calls = Change.write, []

    def failing(self, *args, **more):
        calls.append(args[0])
        if len(calls) > after:
            raise RuntimeError("killed")
        return write(self, *args, **more)

    monkeypatch.setattr(Change, "write", failing)
    new = Delivery(spark, facts(spark, "2024-07-01", "2025-01-01", net=70), item_days(spark, (9, 1, "2024-05-02", 1, 1, 1)))
    new.located_stores = stores(spark, (1, "a", 1), (2, "b", 1))
    with pytest.raises(RuntimeError, match="killed"):
        loading.load(new, root, mode=mode)
    assert len(calls) == after + 1 and contents(root, spark) == before and written(tmp_path) == files
    monkeypatch.undo()
    loading.load(new, root, mode=mode)  # and it can be run again
    assert len(contents(root, spark)["stores"]) == 2


def test_facts_are_checked_before_anything_is_written(spark, tmp_path):
    root = str(tmp_path / "lake")
    first_load(spark, root)
    before, files = contents(root, spark), written(tmp_path)
    good = facts(spark, "2024-09-01")
    twice = item_days(spark, (1, 1, "2024-09-01", 1, 1, 1), (1, 1, "2024-09-01", 2, 1, 1))
    late = item_days(spark, (1, 1, "2030-09-01", 1, 1, 1))
    for bad, error in ((twice, loading.DuplicateKeyError), (late, loading.OutOfRangeError)):
        with pytest.raises(error):
            loading.load(Delivery(spark, good, bad), root)
    assert contents(root, spark) == before and written(tmp_path) == files


def test_two_loads_at_once(spark, tmp_path):
    """The load that ends last was checked against tables that are no longer the live ones."""
    root, layout = str(tmp_path / "lake"), LAYOUTS["da_stores_date"]
    with pytest.raises(ConcurrentLoadError), Change(spark, root) as slow:
        loading.put_facts(slow, facts(spark, "2024-05-01"), layout)
        loading.write_facts(facts(spark, "2024-05-02"), root, layout)
    assert [d.day for d, _ in stored(spark, root)] == [2]
    loading.write_facts(facts(spark, "2024-05-01"), root, layout)
    assert [d.day for d, _ in stored(spark, root)] == [1, 2]


def test_a_reader_keeps_its_version(spark, tmp_path):
    root, layout = str(tmp_path / "lake"), LAYOUTS["da_stores_date"]
    loading.write_facts(facts(spark, "2024-05-01"), root, layout)
    old, frame = Lake(spark, root).pinned(), Lake(spark, root).store_days()
    loading.write_facts(facts(spark, "2024-05-01", net=50), root, layout)
    assert rows(frame, "total_net") == rows(old.store_days(), "total_net") == [(10,)]
    assert rows(Lake(spark, root).store_days(), "total_net") == [(50,)]
    assert vacuum(spark, root, hours=1) == ["_versions/1.json"]  # young folders may belong to a running load
    gone = vacuum(spark, root, hours=-1)
    assert len([g for g in gone if g.startswith("da_stores_date/load=")]) == 1
    assert rows(Lake(spark, root).store_days(), "total_net") == [(50,)]


# --- columns ---


def narrow(spark, *days, net=10):
    return facts(spark, *days, net=net).drop("total_doc", "total_discount")


@pytest.mark.parametrize("wide_first", [True, False])
def test_merges_keep_columns_that_a_delivery_lacks(spark, tmp_path, wide_first):
    root, layout = str(tmp_path / "lake"), LAYOUTS["da_stores_date"]
    deliveries = [facts(spark, "2024-01-01"), narrow(spark, "2023-01-01")]
    for df in deliveries if wide_first else deliveries[::-1]:
        loading.write_facts(df, root, layout)
    loading.write_facts(narrow(spark, "2024-01-02", net=20), root, layout)
    loading.write_facts(narrow(spark, "2023-01-02", net=20), root, layout)
    lake = Lake(spark, root)
    assert sorted(rows(lake.store_days(), "date", "total_net", "total_doc")) == [
        (date(2023, 1, 1), 10, None),
        (date(2023, 1, 2), 20, None),
        (date(2024, 1, 1), 10, 12),
        (date(2024, 1, 2), 20, None),
    ]
    assert lake.store_days().columns == facts(spark, "2024-01-01").columns
    assert all(f.dataType == STORE_DAYS[f.name].dataType for f in lake.store_days().schema)


def test_unknown_columns_and_values_outside_a_type_stop_a_load(spark, tmp_path):
    root, layout = str(tmp_path / "lake"), LAYOUTS["da_stores_date"]
    with pytest.raises(ValueError, match="colour"):
        loading.write_facts(facts(spark, "2024-05-01").withColumn("colour", F.lit(1)), root, layout)
    with pytest.raises(Exception):
        loading.write_facts(facts(spark, "2024-05-01").withColumn("total_net", F.lit("ten")), root, layout)
    assert Lake(spark, root).version().tables == {}
    with pytest.raises(ValueError, match="nothing is stored"):
        Lake(spark, root).store_days()


def test_newest_dates_open_the_newest_directories_only(spark, tmp_path):
    root, layout = str(tmp_path / "lake"), LAYOUTS["da_stores_date"]
    loading.write_facts(facts(spark, "2022-01-01", "2023-01-01", "2024-01-01", "2024-01-02"), root, layout)
    lake = Lake(spark, root)
    opened = []
    newest = Lake._newest_directories

    def noted(self, name):
        for df in newest(self, name):
            opened.append(len(df.inputFiles()))
            yield df

    Lake._newest_directories = noted
    try:
        assert lake.newest_dates(2) == (date(2024, 1, 1), date(2024, 1, 3)) and len(opened) == 1
        assert lake.newest_dates(3) == (date(2023, 1, 1), date(2024, 1, 3)) and len(opened) == 3
        assert lake.newest_dates(9) == (date(2022, 1, 1), date(2024, 1, 3))
    finally:
        Lake._newest_directories = newest


def test_rolled_up_facts_take_no_shuffle_for_the_write(source):
    """Rows come in ranges of days, which the grouping and the directories both follow."""
    dealt = source.by_day
    for table, df in (("da_stores_date", dealt.store_days()), ("da_items_stores_date", dealt.item_days())):
        assert in_ranges_of(loading.dated(typed(df, table), LAYOUTS[table]), "date")
    assert not in_ranges_of(source.store_days(), "date")
    for got, want in ((dealt.store_days(), source.store_days()), (dealt.item_days(), source.item_days())):
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_facts_are_written_once(spark, tmp_path, monkeypatch):
    """Nothing but rows without a date range is staged, and stored rows beside the delivered days are not joined."""
    root, staged, kept = str(tmp_path / "lake"), [], []
    stage, write = Change.staged, Change.write

    def staging(self, df, name):
        out = stage(self, df, name)
        staged.append(out.count())
        return out

    def writing(self, name, df, order, parts=(), replaces=(), **more):
        if replaces:
            kept.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, name, df, order, parts, replaces, **more)

    monkeypatch.setattr(Change, "staged", staging)
    monkeypatch.setattr(Change, "write", writing)
    loading.load(Delivery(spark, facts(spark, "2024-01-05", "2024-05-01", "2024-09-01"), None), root)
    loading.load(Delivery(spark, facts(spark, "2024-05-01", net=50), None), root)
    assert staged == [0, 0] and len(kept) == 1
    assert "Union" in kept[0] and kept[0].index("Union") < kept[0].index("Join LeftAnti")
    assert stored(spark, root) == [(date(2024, 1, 5), 10), (date(2024, 5, 1), 50), (date(2024, 9, 1), 10)]


def test_lines_of_a_load_are_shuffled_once_and_narrow(source):
    """Lines are grouped by order where they are grouped by day, and amounts are multiplied there."""
    for facts in (source.by_day.store_days(), source.by_day.item_days()):
        text = facts._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in text
        shuffled = re.search(r"Project \[(.*)", text.split("Exchange rangepartitioning")[1])[1]
        names = set(re.findall(r"(\w+)#\d+L?(?=[,\]])", shuffled))
        assert {"quantity", "gross", "rate", "vat_factor"} <= names and not {"net", "discount"} & names


def test_loads_take_smaller_shuffle_partitions(spark, source):
    key = "spark.sql.shuffle.partitions"
    keep = spark.conf.get(key)
    big = spark.range(1 << 24)  # 128 MB
    loading.size_shuffles(spark, big)
    assert int(spark.conf.get(key)) >= 16
    session.size_shuffles(spark, source.stores)
    assert spark.conf.get(key) == keep


def test_landing_files_may_be_compressed(spark, tmp_path):
    i = item_days(spark, (1, 1, "2024-05-01", 2, 10, 12), (2, 1, "2024-06-01", 1, 5, 6))
    loading.write_csv(i, str(tmp_path / "da_items_stores_date_all"), "gzip")
    assert list((tmp_path / "da_items_stores_date_all").glob("*.csv.gz"))
    got = Landing(spark, str(tmp_path), "csv").item_days().select(*i.columns)
    assert sorted(rows(got), key=repr) == sorted(rows(i), key=repr)
