"""Daily facts rolled up from transaction lines.

The facts the analyses read are one row per store and day, and one row per
item, store and day. This source derives them from sales lines, order headers
and the supplier (store) and part (item) lists.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytally.functions.measures import columns
from daytally.functions.windows import Window
from daytally.schemas import MEASURE

# --- fixed values: columns of the transaction tables ---
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# counts over one row per order
COUNTS = {
    "nr_sales": "count(*)",
    "nr_persons": "count(DISTINCT customer_id)",
    "nr_credits": "count_if(returned)",
}
STORE_MEASURES = (
    "nr_sales",
    "nr_persons",
    "total_quantity",
    "total_net",
    "total_doc",
    "nr_credits",
    "credits_total_net",
    "total_discount",
)
ITEM_MEASURES = ("total_quantity", "total_net", "total_price", "latest_price_cost", "total_discount")


def _code(prefix: str, key: str, width: int) -> str:
    """Zero-padded code; a key longer than the width is kept whole."""
    digits = f"CAST({key} AS STRING)"
    return f"concat('{prefix}', lpad({digits}, greatest(length({digits}), {width}), '0'))"


def _hundredths(name: str) -> str:
    """An amount with two decimals as a whole number of hundredths.

    Line amounts are multiplied and summed as scaled integers, which is exact
    and much cheaper than decimals. A sum that leaves the range raises an error
    (ANSI arithmetic); the limit, 9.2e12 with VAT per group, is that of MEASURE.
    An amount with more decimals raises an error too; nothing is rounded away.
    """
    whole = f"rint({name} * 100)"
    finer = f"raise_error(concat('{name} has more than two decimals: ', CAST({name} AS STRING)))"
    return f"CASE WHEN abs({name} * 100 - {whole}) > 1e-5 THEN {finer} ELSE CAST({whole} AS BIGINT) END"


def sale_lines(lineitem: DataFrame, window: Window | None = None) -> DataFrame:
    """Sales lines with amounts as scaled integers.

    The window is applied to the stored timestamp, not to the derived date, so
    that it reaches the Parquet scan.
    """
    if window is not None:
        lo, hi = (x if isinstance(x, Column) else F.expr(f"TIMESTAMP_NTZ'{x}'") for x in window)
        lineitem = lineitem.filter((F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi))
    gross, discount = _hundredths("l_extendedprice"), _hundredths("l_discount")
    return lineitem.selectExpr(
        "l_orderkey AS order_id",
        "l_partkey AS item_id",
        "l_suppkey AS store_id",
        "CAST(l_shipdate AS DATE) AS date",
        "l_returnflag = 'R' AS returned",
        f"{_hundredths('l_quantity')} AS quantity",  # 1e-2
        f"{gross} AS gross",  # 1e-2
        f"{discount} AS rate",  # 1e-2
        f"{gross} * (100 - {discount}) AS net",  # 1e-4
        f"100 + {_hundredths('l_tax')} AS vat_factor",  # 1e-2
        f"{gross} * {discount} AS discount",  # 1e-4
    )


# scaled sum of each measure, and its number of decimals. Sums are taken of products of the
# line's own amounts, since a price and a rate take fewer bytes in a shuffle than what they make
NET = "gross * (100 - rate)"
SUMS = {
    "total_quantity": ("sum(quantity)", 2),
    "total_net": (f"sum({NET})", 4),
    "total_doc": (f"sum({NET} * vat_factor)", 6),
    "total_price": (f"sum({NET} * vat_factor)", 6),
    "credits_total_net": (f"sum(CASE WHEN returned THEN {NET} ELSE 0 END)", 4),
    "total_discount": ("sum(gross * rate)", 4),
}


def _measure(name: str) -> str:
    """A scaled sum as a decimal measure."""
    unit = Decimal(1).scaleb(-SUMS[name][1])
    return f"CAST(CAST({name} AS DECIMAL(19,0)) * {unit:f}BD AS {MEASURE.simpleString()})"


def by_days(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks by ranges of day and store.

    Groupings by store and day, and finer ones, need no other shuffle, and a task's rows lie
    in few directories, so that facts are written as they come: one shuffle in place of
    one for the grouping and one for the write. It is for loads: what one
    store, or item and store, sells in a day reaches its task unsummed.
    """
    return df.repartitionByRange("date", "store_id")


def roll_up_store_days(
    lines: DataFrame, orders: DataFrame, measures: tuple[str, ...] = STORE_MEASURES, by_day: bool = False
) -> DataFrame:
    """One row per store and day with the chosen measures, or none of them; in
    ranges of days if asked for (`by_days`).

    Counts of sales come from a first grouping per order, which leaves a single
    distinct count (customers) for the second one, so no row is multiplied for
    several distinct counts. The header join and that grouping share one
    partitioning by order; in ranges of days, lines are dealt before that grouping, which
    would make hardly fewer rows and much wider ones. Order headers are read only when
    customers are counted; a line without a header still counts as a sale.
    """
    sums = {name: SUMS[name][0] for name in measures if name in SUMS}
    keys = ["store_id", "date"]
    counts = {name: COUNTS[name] for name in measures if name in COUNTS}
    if not measures:
        return lines.select(*keys).distinct()
    dealt = by_days if by_day else lambda df: df
    if not counts:
        daily = dealt(lines).groupBy(*keys).agg(*columns(**sums))
    else:
        per_order = [*keys, "order_id"]
        if "nr_persons" in counts:
            lines = lines.join(orders.selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id"), "order_id", "left")
            per_order.append("customer_id")
        sold = dealt(lines).groupBy(*per_order).agg(*columns(returned="max(returned)", **sums))
        daily = sold.groupBy(*keys).agg(*columns(**{name: f"sum({name})" for name in sums}, **counts))
    made = [f"{_measure(name)} AS {name}" if name in sums else name for name in STORE_MEASURES if name in measures]
    return daily.selectExpr(*keys, *made)


def roll_up_item_days(
    lines: DataFrame, part: DataFrame, measures: tuple[str, ...] = ITEM_MEASURES, by_day: bool = False
) -> DataFrame:
    """One row per item, store and day, in ranges of days if asked for (`by_days`). The unit
    cost is the item's list price."""
    keys = ["item_id", "store_id", "date"]
    lines = by_days(lines) if by_day else lines
    sums = {name: SUMS[name][0] for name in measures if name in SUMS}
    facts = lines.groupBy(*keys).agg(*columns(**sums)) if sums else lines.select(*keys).distinct()
    if "latest_price_cost" in measures:
        price = f"CAST(p_retailprice AS {MEASURE.simpleString()}) AS latest_price_cost"
        facts = facts.join(part.selectExpr("p_partkey AS item_id", price), "item_id", "left")
    made = [f"{_measure(name)} AS {name}" if name in sums else name for name in ITEM_MEASURES if name in measures]
    return facts.selectExpr(*keys, *made)


# --- parts: sums that late lines can be added to ---

ORDER_SUMS = tuple(name for name in STORE_MEASURES if name in SUMS)
ITEM_SUMS = tuple(name for name in ITEM_MEASURES if name in SUMS)


def order_parts(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order, store and day: sums of its lines as scaled integers, the
    customer, and whether a line was returned."""
    headers = orders.selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id")
    sums = {name: SUMS[name][0] for name in ORDER_SUMS}
    kept = columns(customer_id="max(customer_id)", returned="max(returned)", **sums)
    return lines.join(headers, "order_id", "left").groupBy("store_id", "date", "order_id").agg(*kept)


def item_parts(lines: DataFrame) -> DataFrame:
    """One row per item, store and day: sums of its lines as scaled integers."""
    return lines.groupBy("item_id", "store_id", "date").agg(*columns(**{name: SUMS[name][0] for name in ITEM_SUMS}))


def store_days_of(parts: DataFrame) -> DataFrame:
    """Store-days from order parts of any number of deliveries: an order that several
    of them have is one sale, and a customer of several orders is one customer."""
    added = {name: f"sum({name})" for name in ORDER_SUMS}
    orders = parts.groupBy("store_id", "date", "order_id").agg(
        *columns(customer_id="max(customer_id)", returned="max(returned)", **added)
    )
    daily = orders.groupBy("store_id", "date").agg(*columns(**added, **COUNTS))
    made = [f"{_measure(name)} AS {name}" if name in SUMS else name for name in STORE_MEASURES]
    return daily.selectExpr("store_id", "date", *made)


def item_days_of(parts: DataFrame, part: DataFrame, single: bool = False) -> DataFrame:
    """Item-days from item parts, of a single delivery or of any number of them; the unit
    cost is the item's list price."""
    keys = ["item_id", "store_id", "date"]
    daily = parts if single else parts.groupBy(*keys).agg(*columns(**{name: f"sum({name})" for name in ITEM_SUMS}))
    price = f"CAST(p_retailprice AS {MEASURE.simpleString()}) AS latest_price_cost"
    daily = daily.join(part.selectExpr("p_partkey AS item_id", price), "item_id", "left")
    made = [f"{_measure(name)} AS {name}" if name in SUMS else name for name in ITEM_MEASURES]
    return daily.selectExpr(*keys, *made)


class Transactions:
    """Dimensions and daily facts over a folder of transaction tables."""

    keys_are_grouped = True  # fact keys are grouping keys, hence unique

    def __init__(self, spark: SparkSession, folder: str, in_ranges: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.in_ranges = in_ranges

    @property
    def by_day(self) -> Transactions:
        """The same source, with facts that come in ranges of days (`by_days`)."""
        return Transactions(self.spark, self.folder, True)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def _store_list(self, *more: str) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS id",
            "s_name AS name",
            f"{_code('S', 's_suppkey', 4)} AS code",
            "CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END AS status",
            *more,
        )

    @property
    def stores(self) -> DataFrame:
        return self._store_list()

    @property
    def located_stores(self) -> DataFrame:
        """Stores with their location and sector, which most analyses do not need."""
        region = self.table("region").selectExpr("r_regionkey AS n_regionkey", "r_name AS sector")
        places = (
            self.table("nation")
            .join(region, "n_regionkey", "left")
            .selectExpr("n_nationkey AS s_nationkey", "n_name AS location", "sector")
        )
        return self._store_list("s_nationkey").join(places, "s_nationkey", "left").drop("s_nationkey")

    @property
    def items(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS id",
            f"{_code('P', 'p_partkey', 8)} AS pcode",
            "concat(p_name, ' ', CAST(p_partkey AS STRING)) AS description",
            "CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS status",
            "CAST(replace(p_brand, 'Brand#', '') AS INT) AS family_id",
            "p_size AS group_id",
        )

    def store_days(self, window: Window | None = None, measures: tuple[str, ...] = STORE_MEASURES) -> DataFrame:
        return roll_up_store_days(sale_lines(self.table("lineitem"), window), self.table("orders"), measures, self.in_ranges)

    def item_days(self, window: Window | None = None, measures: tuple[str, ...] = ITEM_MEASURES) -> DataFrame:
        return roll_up_item_days(sale_lines(self.table("lineitem"), window), self.table("part"), measures, self.in_ranges)

    def _newest(self, shift: int) -> Column:
        newest = F.date_add(F.to_date(F.max("l_shipdate")), shift).cast("timestamp_ntz")
        return self.table("lineitem").agg(newest).scalar()

    def newest_window(self, days: int) -> tuple[Column, Column]:
        """The last `days` days up to the newest sale, as bounds of the stored
        timestamp: subqueries over that column alone, whose values the scan filters on."""
        return self._newest(-days), self._newest(1)

    def newest_dates(self, k: int) -> tuple[Column, Column]:
        """The window of the k newest dates with sales."""
        dates = self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.lit(1).alias("one"))
        newest = dates.orderBy(F.desc("date")).limit(k)
        return newest.agg(F.min("date").cast("timestamp_ntz")).scalar(), self._newest(1)

    def store_ids(self) -> DataFrame:
        """Stores with any fact, from the key column alone."""
        return self.table("lineitem").selectExpr("l_suppkey AS store_id").distinct()
