"""Late lines on top of a stored lake, by hand and against a full roll-up."""

import re
from datetime import date, datetime

import pytest
from helpers import rows

from daytally.operators import increments, loading
from daytally.schemas import Layout
from daytally.sources import versions
from daytally.sources.lake import Lake
from daytally.sources.transactions import TABLES, roll_up_item_days, roll_up_store_days, sale_lines

LAYOUTS = {
    "da_stores_date": Layout("da_stores_date", "year", 2020, 2030),
    "da_items_stores_date": Layout("da_items_stores_date", "month", 2020, 2030),
}


class Delivered:
    def __init__(self, spark, lines, orders):
        """lines: order, item, store, day, quantity, price, returned; orders: order, customer"""
        self.spark = spark
        full = [
            (o, i, s, n, float(q), float(p), 0.1, 0.2, "R" if r else "N", "O", datetime.fromisoformat(d))
            for n, (o, i, s, d, q, p, r) in enumerate(lines)
        ]
        part = [(i, f"item {i}", "Brand#1", 1, 2.5) for i in range(1, 9)]
        self._tables = {"lineitem": full, "orders": orders, "part": part}

    def table(self, name):
        return self.spark.createDataFrame(self._tables[name], TABLES[name])


FIRST = [(1, 1, 1, "2024-01-05", 2, 10, 0), (1, 2, 1, "2024-01-05", 1, 5, 0), (2, 1, 1, "2024-01-05", 1, 7, 1), (3, 1, 2, "2023-06-01", 1, 3, 0)]
LATE = [(1, 3, 1, "2024-01-05", 1, 4, 1), (4, 1, 1, "2024-01-05", 1, 1, 0), (5, 1, 1, "2024-03-01", 1, 2, 0)]
ORDERS = [(1, 70), (2, 70), (3, 71)]
LATE_ORDERS = [(1, 70), (4, 72)]  # no header for order 5 yet


def lake_of(spark, root, *deliveries):
    for i, (lines, orders) in enumerate(deliveries):
        assert increments.add_lines(Delivered(spark, lines, orders), root, f"d{i}", LAYOUTS)
    return Lake(spark, root)


def whole(spark, lines, orders):
    source = Delivered(spark, lines, orders)
    sold = sale_lines(source.table("lineitem"))
    return roll_up_store_days(sold, source.table("orders")), roll_up_item_days(sold, source.table("part"))


def same(lake, store_days, item_days):
    for got, want in ((lake.store_days(), store_days), (lake.item_days(), item_days)):
        assert got.columns == want.columns
        assert sorted(rows(got), key=repr) == sorted(rows(want), key=repr)


def test_late_lines_are_counted_once(spark, tmp_path):
    root = str(tmp_path / "lake")
    lake = lake_of(spark, root, (FIRST, ORDERS), (LATE, LATE_ORDERS))
    day = lake.store_days().filter("date = DATE'2024-01-05'")
    # orders 1, 2 and 4 of customers 70 and 72; 1 (by its late line) and 2 have returns
    assert rows(day, "nr_sales", "nr_persons", "nr_credits") == [(3, 2, 2)]
    same(lake, *whole(spark, FIRST + LATE, ORDERS + [(4, 72)]))
    before = lake.version()
    assert not increments.add_lines(Delivered(spark, LATE, LATE_ORDERS), root, "d1", LAYOUTS)
    assert lake.version() == before


def test_a_header_that_comes_later(spark, tmp_path):
    lake = lake_of(spark, str(tmp_path), (LATE, LATE_ORDERS), ([(5, 2, 1, "2024-03-01", 1, 2, 0)], [(5, 73)]))
    assert rows(lake.store_days().filter("date = DATE'2024-03-01'"), "nr_sales", "nr_persons") == [(1, 1)]


def test_only_touched_directories_are_read_and_replaced(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    lake = lake_of(spark, root, (FIRST, ORDERS))
    before, opened = lake.version().tables, []
    read = versions.Change.read

    def noted(self, name, directories=None):
        df = read(self, name, directories)
        opened.extend(df.inputFiles())
        return df

    monkeypatch.setattr(versions.Change, "read", noted)
    lake_of_late = Delivered(spark, LATE, LATE_ORDERS)
    assert increments.add_lines(lake_of_late, root, "late", LAYOUTS)
    assert opened and not any("year=2023" in f for f in opened)
    after = lake.version().tables
    for name in before:
        untouched = [d for d in before[name].directories if "year=2023" in d]
        assert untouched and set(untouched) <= set(after[name].directories)
    assert set(before["order_parts"].directories) < set(after["order_parts"].directories)
    assert not set(d for d in before["da_stores_date"].directories if "year=2024" in d) & set(after["da_stores_date"].directories)


def test_a_failed_delivery_leaves_nothing_and_runs_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    lake = lake_of(spark, root, (FIRST, ORDERS))
    before = lake.version()
    monkeypatch.setattr(increments, "item_days_of", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        increments.add_lines(Delivered(spark, LATE, LATE_ORDERS), root, "late", LAYOUTS)
    assert lake.version() == before
    monkeypatch.undo()
    with pytest.raises(loading.OutOfRangeError):
        increments.add_lines(Delivered(spark, [(9, 1, 1, "2031-01-01", 1, 1, 0)], []), root, "far", LAYOUTS)
    assert lake.version() == before
    assert increments.add_lines(Delivered(spark, LATE, LATE_ORDERS), root, "late", LAYOUTS)
    same(lake, *whole(spark, FIRST + LATE, ORDERS + [(4, 72)]))


def test_compaction_changes_no_result(spark, tmp_path):
    root = str(tmp_path / "lake")
    lake = lake_of(spark, root, (FIRST, ORDERS), (LATE, LATE_ORDERS))
    increments.compact(spark, root, LAYOUTS)
    parts = lake.version().tables["order_parts"].directories
    assert len(parts) == 2 and lake.table("order_parts").count() == 5
    number = lake.version().number
    increments.compact(spark, root, LAYOUTS)
    assert lake.version().number == number
    assert increments.add_lines(Delivered(spark, [(2, 4, 1, "2024-01-05", 1, 1, 0)], []), root, "more", LAYOUTS)
    same(lake, *whole(spark, [*FIRST, *LATE, (2, 4, 1, "2024-01-05", 1, 1, 0)], ORDERS + [(4, 72)]))


def test_an_empty_delivery(spark, tmp_path):
    lake = lake_of(spark, str(tmp_path), (FIRST, ORDERS), ([], []))
    same(lake, *whole(spark, FIRST, ORDERS))
    assert lake.newest_date() == date(2024, 1, 5)


def moved(work):
    """Shuffles of the first write of each table, the one that lays rows out included."""
    texts, write = [], versions.Change.write

    def noted(self, name, df, order, parts=(), *args, **more):
        if not more.get("laid_out"):
            df = df.hint("rebalance", *parts)
        texts.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, name, df, order, parts, *args, **{**more, "laid_out": True})

    versions.Change.write = noted
    try:
        work()
    finally:
        versions.Change.write = write
    return {name: len(re.findall(r"(?<!\w)Exchange ", text)) for name, text in reversed(texts)}


def test_rows_are_shuffled_once_for_grouping_and_write(spark, tmp_path):
    """Orders meet their lines, and every other table takes one shuffle or none."""
    root, files = str(tmp_path / "lake"), str(tmp_path / "part")
    first = Delivered(spark, FIRST, ORDERS)
    first.table("part").write.parquet(files)

    class Listed:  # an item list of known size, which is broadcast
        def table(self, name):
            return spark.read.parquet(files) if name == "part" else first.table(name)

    Listed.spark = spark
    n = moved(lambda: increments.add_lines(Listed(), root, "first", LAYOUTS))
    assert n["item_parts"] == 1 and n["da_stores_date"] == 1 and n["da_items_stores_date"] == 0
    later = moved(lambda: increments.add_lines(Delivered(spark, LATE, LATE_ORDERS), root, "late", LAYOUTS))
    assert later["item_parts"] == 1
    same(Lake(spark, root), *whole(spark, FIRST + LATE, ORDERS + [(4, 72)]))


def test_lines_without_a_store_or_item_make_no_fact(spark, tmp_path):
    lines = [*FIRST, (6, None, 1, "2024-01-05", 1, 8, 0), (7, 1, None, "2024-02-05", 1, 9, 0)]
    lake = lake_of(spark, str(tmp_path / "lake"), (lines, ORDERS), (LATE, LATE_ORDERS))
    assert {r.store_id for r in lake.store_days().collect()} == {1, 2}
    assert all(r.item_id and r.store_id for r in lake.item_days().collect())
    assert lake.table("order_parts").filter("store_id IS NULL").count() == 1
