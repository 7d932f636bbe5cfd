"""Late lines: daily facts kept up to date without rolling everything up again.

Counts of sales and of distinct customers do not add up from one delivery to the
next. The lake therefore keeps the sums they are made of: a row per order, store
and day of each delivery (`order_parts`), and a row per item, store and day
(`item_parts`). A delivery adds its own rows to them, and the store-days and
item-days it has lines for, no others, are rolled up anew from the parts of the
years or months they fall into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.operators.loading import OutOfRangeError, dated, put_facts, within
from daytally.schemas import KEYS, LAYOUTS, Layout
from daytally.session import in_ranges_of, shuffles, size_shuffles
from daytally.sources.transactions import by_days, item_days_of, item_parts, order_parts, sale_lines, store_days_of
from daytally.sources.versions import Change, values


def _put_parts(change: Change, name: str, parts: DataFrame, layout: Layout, laid_out: bool = False) -> tuple[str, ...]:
    """Add a delivery's parts; the stored ones stay as they are. Returns the new directories."""
    rows = dated(parts, layout)
    laid_out = laid_out or in_ranges_of(rows, "date")
    return change.write(name, rows, ["store_id", "date"], tuple(layout.columns), laid_out=laid_out)


def _touched_parts(change: Change, name: str, new: tuple[str, ...], layout: Layout) -> DataFrame:
    """The parts of every key that the new directories have: theirs, and those of other
    deliveries from the same years or months and between the first and the last new day.
    Parts without a whole key belong to no fact."""
    keys, rows, touched = KEYS[layout.table], change.read(name, new), change.touched(name, new)
    if touched:
        held = change.read(name, touched)
        inside, _ = within(held, rows)
        rows = rows.unionByName(held.filter(inside).join(rows.select(*keys).distinct(), keys, "left_semi"))
    return rows.dropna(subset=keys).drop(*layout.columns)


def add_lines(source, root: str, delivery: str, layouts: dict[str, Layout] | None = None) -> bool:
    """Take a delivery of sales lines into the lake below root; True when it is new.

    `source` has the delivery's tables lineitem, orders (the headers it knows; one
    that comes later counts from then on) and part. The facts are afterwards
    what a roll-up of all deliveries' lines gives. Parts, facts and the delivery's
    name become live in one step, so a delivery that failed is run again, and one that
    was applied is not counted twice, however often it is sent. Store and item lists
    are not touched.

    Reads and rewrites only the directories of years and months that the lines fall
    into, of the parts only rows of the touched store-days and item-days. Parts of
    orders are written by the tasks that made them, a file for each of a task's years.
    Item-days of a month that no other delivery has lines of are the delivery's parts,
    and take no shuffle.
    Facts must have come in this way from the start: a fact without parts is
    replaced by what the delivery says of its day. A day beyond the layouts' ranges
    stops the load. Amounts are the source's; a line delivered twice under two
    names counts twice.
    """
    spark, layouts = source.spark, layouts or LAYOUTS
    stores, items = layouts["da_stores_date"], layouts["da_items_stores_date"]
    with Change(spark, root) as change:
        if delivery in change.deliveries:
            return False
        lines = source.table("lineitem")
        size_shuffles(spark, lines)
        lines = sale_lines(lines)
        accepted = stores.accepts(F.col("date")) & items.accepts(F.col("date"))
        out = lines.filter(~accepted).select(*KEYS[items.table]).distinct().count()
        if out:
            raise OutOfRangeError(f"{delivery}: {out} item-days have dates that no range takes")
        by_order = _put_parts(change, "order_parts", order_parts(lines, source.table("orders")), stores, laid_out=True)
        by_item = _put_parts(change, "item_parts", item_parts(by_days(lines)), items)
        put_facts(change, store_days_of(by_days(_touched_parts(change, "order_parts", by_order, stores))), stores)
        held = [values(d) for d in change.touched("item_parts", by_item)]
        shared = tuple(d for d in by_item if values(d) in held)
        if shared:
            parts = by_days(_touched_parts(change, "item_parts", shared, items))
            put_facts(change, item_days_of(parts, source.table("part")), items)
        alone = tuple(d for d in by_item if values(d) not in held)
        if alone:
            parts = change.read("item_parts", alone).dropna(subset=KEYS[items.table]).drop(*items.columns)
            item_days = item_days_of(parts, source.table("part"), True)
            put_facts(change, item_days, items, laid_out=not shuffles(item_days))
        change.applied(delivery)
    return True


def compact(spark, root: str, layouts: dict[str, Layout] | None = None) -> None:
    """Add up the parts of all deliveries, where a directory has those of several: one
    row per order, or item, store and day, and one directory per year or month."""
    layouts = layouts or LAYOUTS
    with Change(spark, root) as change:
        for name, layout, keys in (
            ("order_parts", layouts["da_stores_date"], ["store_id", "date", "order_id"]),
            ("item_parts", layouts["da_items_stores_date"], ["item_id", "store_id", "date"]),
        ):
            several = change.several(name)
            if several:
                parts = change.read(name, several).drop(*layout.columns)
                size_shuffles(spark, parts)
                kept = {"customer_id": "max", "returned": "max"}
                sums = [f"{kept.get(c, 'sum')}({c}) AS {c}" for c in parts.columns if c not in keys]
                added = parts.groupBy(*keys).agg(*map(F.expr, sums))
                change.write(name, dated(added.select(*parts.columns), layout), ["store_id", "date"], tuple(layout.columns), several)
