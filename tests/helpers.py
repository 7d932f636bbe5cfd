"""Small hand-made tables."""

from datetime import date
from decimal import Decimal

from daytally.schemas import MEASURE

STORE_SCHEMA = "id bigint, name string, code string, status int, location string, sector string"
ITEM_SCHEMA = "id bigint, pcode string, description string, status int, family_id int, group_id int"
STORE_DAY_SCHEMA = (
    "store_id bigint, date date, nr_sales bigint, nr_persons bigint, total_quantity decimal(18,5), "
    "total_net decimal(18,5), total_doc decimal(18,5), total_discount decimal(18,5)"
)
ITEM_DAY_SCHEMA = (
    "item_id bigint, store_id bigint, date date, total_quantity decimal(18,5), total_net decimal(18,5), "
    "total_price decimal(18,5), latest_price_cost decimal(18,5), total_discount decimal(18,5)"
)


def d(text):
    return date.fromisoformat(text)


def dec(x):
    return None if x is None else Decimal(str(x))


def stores(spark, *rows):
    """rows: id, name, status[, location]"""
    full = [(r[0], r[1], f"S{r[0]}", r[2], r[3] if len(r) > 3 else "Braga", "retail") for r in rows]
    return spark.createDataFrame(full, STORE_SCHEMA)


def items(spark, *ids):
    return spark.createDataFrame([(i, f"P{i}", f"item {i}", 1, i % 3, i % 2) for i in ids], ITEM_SCHEMA)


def store_days(spark, *rows):
    """rows: store, date, net[, sales[, persons]]"""
    full = []
    for store, day, net, *rest in rows:
        sales = rest[0] if rest else 10
        persons = rest[1] if len(rest) > 1 else 5
        doc = None if net is None else net * 1.2
        full.append((store, d(day), sales, persons, dec(100), dec(net), dec(doc), dec(1)))
    return spark.createDataFrame(full, STORE_DAY_SCHEMA)


def item_days(spark, *rows):
    """rows: item, store, date, quantity, net, cost"""
    full = [
        (i, s, d(day), dec(q), dec(net), dec(None if net is None else net * 1.2), dec(cost), dec(0))
        for i, s, day, q, net, cost in rows
    ]
    return spark.createDataFrame(full, ITEM_DAY_SCHEMA)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


assert MEASURE.simpleString() == "decimal(18,5)"
