"""The catalogue: every analysis under a name, with its parameters.

An entry takes a source (`Transactions` or `Lake`), asks it for the dates and
measures it needs, and returns a DataFrame. AS_OF stands in for "today".
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from daytally.functions import windows as w
from daytally.functions.calendar import calendar
from daytally.operators import baskets, bundles, checks, compare, forecasts, increments, items, loading, periods, stores, trends
from daytally.schemas import KEYS, Layout
from daytally.session import shared_folder
from daytally.sources.lake import Lake
from daytally.sources.landing import Landing
from daytally.sources.transactions import ITEM_MEASURES

AS_OF = date(2001, 6, 30)
LEAP_DAY = date(2000, 2, 29)
EASTER = (date(2001, 4, 13), date(2001, 4, 15))
CHRISTMAS = (date(2000, 12, 24), date(2000, 12, 25))
HISTORY = w.trailing_years(AS_OF, 3)
SUMMER = (date(2000, 6, 1), date(2000, 9, 1))
TARGET = 7
MANY_TARGETS = list(range(1, 41))
STORE = "Supplier#000000001"
LFL = (date(2000, 6, 24), date(2000, 6, 27)), (date(2001, 6, 24), date(2001, 6, 27))
# ranges that leave some facts in the past range and some without a range
STORE_LAYOUT = Layout("da_stores_date", "year", 1996, 2000)
ITEM_LAYOUT = Layout("da_items_stores_date", "month", 1996, 2000)
# ranges that take every fact
WIDE = {
    "da_stores_date": Layout("da_stores_date", "year", 1990, 2030),
    "da_items_stores_date": Layout("da_items_stores_date", "month", 1990, 2030),
}
EPOCH, END = date(1970, 1, 1), date(2100, 1, 1)

# the places of the data that stand for the cities of local events
CITY_PLACES = {
    "Porto": ["BRAZIL", "PERU"],
    "Braga": ["PERU", "FRANCE"],
    "Guimarães": ["GERMANY"],
    "Ponte de Lima": ["CANADA"],
    "Viseu": ["CHINA", "INDIA", "JAPAN"],
}
TERMS = ("vendas", "receita", "margem", "quantidade", "desconto")

NET = ("total_net",)
FLOW = ("nr_sales", "nr_persons", "total_net")
SALES = ("nr_sales", "total_net")
TRADE = ("total_quantity", "total_net")
COSTED = ("total_quantity", "total_net", "latest_price_cost")
PRICED = ("total_quantity", "total_net", "total_price", "latest_price_cost")

Entry = Callable[..., DataFrame]


def _days(days: int) -> w.Window:
    return w.trailing_days(AS_OF, days)


def _named_window(name: str) -> w.Window:
    return w.date_window(name, AS_OF)


def _fresh(source, name: str) -> str:
    """A folder that belongs to this application, source and entry, so that a
    second run replaces the first."""
    application = source.spark.sparkContext.applicationId
    return f"{shared_folder(source.spark)}/{name}-{application}-{crc32(source.folder.encode()):08x}"


def _stored_counts(source, root: str, **more: DataFrame) -> DataFrame:
    lake = Lake(source.spark, root)
    return checks.row_counts({name: lake.table(name) for name in KEYS} | more)


class Part:
    """The facts of a source inside a window, as one delivery."""

    keys_are_grouped = True

    def __init__(self, source, window: w.Window):
        self.spark, self.source, self.window = source.spark, source, window
        self.located_stores, self.items = source.located_stores, source.items

    @property
    def by_day(self) -> Part:
        return type(self)(getattr(self.source, "by_day", self.source), self.window)

    def store_days(self) -> DataFrame:
        return self.source.store_days(self.window)

    def item_days(self) -> DataFrame:
        return self.source.item_days(self.window)


def _load_and_count(source) -> DataFrame:
    """Load everything and count what arrived."""
    root = _fresh(source, "lake")
    loading.load(source, root, WIDE, mode="replace")
    return _stored_counts(source, root)


def _load_increment_and_count(source) -> DataFrame:
    """Two deliveries that overlap by a month inside one year directory, then the first day of it again."""
    root = _fresh(source, "increments")
    loading.load(Part(source, (EPOCH, date(2000, 7, 1))), root, WIDE, mode="replace")
    loading.load(Part(source, (date(2000, 6, 1), END)), root, WIDE)
    loading.load(Part(source, (date(2000, 6, 1), date(2000, 6, 2))), root, WIDE)
    return _stored_counts(source, root)


def _load_rejects_counted(source) -> DataFrame:
    """Load into ranges that end in 2000, keeping what they do not take."""
    root = _fresh(source, "rejects")
    layouts = {layout.table: layout for layout in (STORE_LAYOUT, ITEM_LAYOUT)}
    rejected = loading.load(source, root, layouts, mode="replace", rejects="keep")
    return _stored_counts(source, root, **{f"rejected_{name}": df for name, df in rejected.items()})


def _load_delta(source) -> DataFrame:
    """Rows before and after the load of the newest deliveries."""
    root = _fresh(source, "delta")
    loading.load(Part(source, (EPOCH, date(2000, 1, 1))), root, WIDE, mode="replace")
    lake = Lake(source.spark, root)
    before = lake.item_days().count()
    loading.load(Part(source, (date(2000, 1, 1), END)), root, WIDE, mode="append")
    return checks.load_delta(before, lake.item_days())


def _merged_store_days(source) -> DataFrame:
    """The stored values after deliveries that overlap inside a year, one of them sent twice."""
    root = _fresh(source, "merged")
    loading.load(Part(source, (EPOCH, date(2000, 7, 1))), root, WIDE, mode="replace")
    for _ in range(2):
        loading.load(Part(source, (date(2000, 6, 1), END)), root, WIDE)
    return Lake(source.spark, root).store_days()


class Narrow(Part):
    """A delivery with fewer measures than others have."""

    def store_days(self) -> DataFrame:
        return self.source.store_days(self.window, FLOW)

    def item_days(self) -> DataFrame:
        return self.source.item_days(self.window, COSTED)


WIDE_DELIVERY, NARROW_YEAR, NARROW_DAY = (EPOCH, date(2000, 1, 1)), (date(2000, 1, 1), END), (date(1999, 6, 1), date(1999, 6, 2))


def _mixed_lake(source, name: str, wide_first: bool) -> Lake:
    """Deliveries with all and with few measures, in either order, then one more day
    with few of a year that has all."""
    root = _fresh(source, name)
    deliveries = [Part(source, WIDE_DELIVERY), Narrow(source, NARROW_YEAR)]
    for i, delivery in enumerate(deliveries if wide_first else deliveries[::-1]):
        loading.load(delivery, root, WIDE, mode="merge" if i else "replace")
    loading.load(Narrow(source, NARROW_DAY), root, WIDE)
    return Lake(source.spark, root)


class Lines:
    """Part of a source's sales lines, as a delivery of its own."""

    def __init__(self, source, condition: str):
        self.spark, self.source, self.condition = source.spark, source, condition

    def table(self, name: str) -> DataFrame:
        df = self.source.table(name)
        return df.filter(self.condition) if name == "lineitem" else df


def _late_lines(source) -> Lake:
    """Three deliveries: lines up to 2000, those of 2000 and later, and, last, the late ones, which
    belong to orders, stores and days of both. The second one is sent again."""
    root = f"{shared_folder(source.spark)}/late-{uuid.uuid4().hex}"
    late, recent = "l_linenumber >= 6 AND l_shipdate >= '1999-10-01' AND l_shipdate < '2000-03-01'", "l_shipdate >= '2000-01-01'"
    increments.add_lines(Lines(source, f"NOT ({late}) AND NOT ({recent})"), root, "old", WIDE)
    increments.add_lines(Lines(source, f"NOT ({late}) AND {recent}"), root, "new", WIDE)
    increments.add_lines(Lines(source, late), root, "late", WIDE)
    increments.add_lines(Lines(source, recent), root, "new", WIDE)
    return Lake(source.spark, root)


def _landed_items(source) -> DataFrame:
    """Facts exported to CSV landing files, loaded from there, and read back."""
    files, root = _fresh(source, "landing"), _fresh(source, "landed")
    dealt = getattr(source, "by_day", source)
    for name, df in {"stores": source.located_stores, "items": source.items}.items():
        loading.write_csv(df, f"{files}/{name}")
    loading.write_csv(dealt.store_days(), f"{files}/da_stores_date_all", "gzip")
    for part, window in {"old": (EPOCH, date(1999, 1, 1)), "new": (date(1999, 1, 1), END)}.items():
        loading.write_csv(dealt.item_days(window), f"{files}/da_items_stores_date_{part}", "gzip")
    loading.load(Landing(source.spark, files, "csv"), root, WIDE, mode="replace")
    return Lake(source.spark, root).item_days(None, ITEM_MEASURES)


def _seasonal(source) -> DataFrame:
    return bundles.seasonal_items(source.item_days(HISTORY, TRADE), source.items, HISTORY)


def _record_days(source) -> DataFrame:
    """Each store's day of highest revenue in a year, as events to study."""
    best = F.max(F.struct("total_net", F.date_diff(F.lit(date(2100, 1, 1)), "date").alias("early"))).alias("b")
    days = source.store_days(w.year_of(2000), NET).groupBy("store_id").agg(best)
    places = source.located_stores.select(F.col("id").alias("store_id"), F.col("name").alias("event"), "location")
    day = F.date_sub(F.lit(date(2100, 1, 1)), F.col("b.early")).alias("day")
    return days.join(places, "store_id").select("event", "location", day)


ENTRIES: dict[str, Entry] = {
    # store analyses
    "sales_on_day": lambda t: stores.sales_on(t.store_days(_named_window("today")), t.stores, AS_OF),
    "sales_on_day_any_status": lambda t: stores.sales_on(t.store_days(_named_window("today")), t.stores, AS_OF, active_only=False),
    "store_day_totals": lambda t: stores.store_day_totals(t.store_days(_named_window("today"), SALES), t.stores, AS_OF),
    "day_total": lambda t: stores.day_total(t.store_days(_named_window("today"), NET), AS_OF),
    "period_total_easter": lambda t: stores.period_total(t.store_days(w.inclusive(*EASTER)), t.stores, "Páscoa 2001", *EASTER),
    "period_total_christmas": lambda t: stores.period_total(t.store_days(w.inclusive(*CHRISTMAS)), t.stores, "Natal 2000", *CHRISTMAS),
    "period_by_store": lambda t: stores.period_by_store(t.store_days(w.inclusive(*EASTER), SALES), t.stores, *EASTER),
    "period_by_store_with_customers": lambda t: stores.period_by_store(
        t.store_days(w.inclusive(*EASTER), FLOW), t.stores, *EASTER, customers=True
    ),
    "store_history": lambda t: stores.store_history(t.store_days(_days(30)), t.stores, STORE, AS_OF),
    "ytd_by_store": lambda t: stores.ytd_by_store(t.store_days(_named_window("this_year"), FLOW), t.stores, AS_OF),
    "annual_by_store": lambda t: stores.annual_by_store(t.store_days(w.trailing_years(AS_OF, 5), FLOW), t.stores, AS_OF),
    "store_ranking": lambda t: stores.store_ranking(t.store_days(_days(30), FLOW), t.stores, AS_OF),
    "weekly_trend": lambda t: stores.weekly_trend(t.store_days(_days(84), FLOW), t.stores, AS_OF),
    "weekday_profile": lambda t: stores.weekday_profile(t.store_days(_days(90), FLOW), t.stores, AS_OF),
    "top_stores_last_month": lambda t: stores.top_stores(
        t.store_days(_named_window("last_month"), NET), t.stores, _named_window("last_month")
    ),
    "stores_averaging_above": lambda t: stores.stores_averaging_above(t.store_days(None, NET), t.stores, 56500),
    "window_totals": lambda t: stores.window_totals(t.store_days(w.trailing_years(AS_OF, 2), SALES), t.stores, AS_OF),
    "daily_sales_30_days": lambda t: stores.daily_sales(t.store_days(_days(30), SALES), t.stores, _days(30)),
    "monthly_sales_of_year": lambda t: stores.monthly_sales(t.store_days(w.year_of(2000), SALES), t.stores, 2000),
    "worst_days_last_month": lambda t: stores.worst_days(
        t.store_days(_named_window("last_month"), SALES), t.stores, _named_window("last_month")
    ),
    "season_comparison": lambda t: stores.season_comparison(t.store_days(HISTORY, NET), t.stores, HISTORY),
    # comparisons
    "yoy_monthly": lambda t: compare.yoy_monthly(t.store_days(w.trailing_years(AS_OF, 2), NET), t.stores, AS_OF),
    "yoy_monthly_leap_day": lambda t: compare.yoy_monthly(t.store_days(w.trailing_years(LEAP_DAY, 2), NET), t.stores, LEAP_DAY),
    "yoy_by_store": lambda t: compare.yoy_by_store(
        t.store_days((date(AS_OF.year - 1, 1, 1), AS_OF + timedelta(days=1)), NET), t.stores, AS_OF, known=t.store_ids()
    ),
    "yoy_by_store_recent": lambda t: compare.yoy_by_store(
        t.store_days(w.trailing_years(AS_OF, 2), NET), t.stores, AS_OF, active_only=False, since=w.add_months(AS_OF, -24)
    ),
    "like_for_like": lambda t: compare.compare(t.store_days((LFL[0][0], LFL[1][1]), NET), t.stores, *LFL, scope="lfl"),
    "comparable_stores": lambda t: compare.comparable_stores(t.store_days((LFL[0][0], LFL[1][1]), NET), list(LFL)),
    # item analyses
    "top_items_by_revenue": lambda t: items.top_items(t.item_days(_days(30), PRICED), t.items, "revenue", AS_OF),
    "top_items_by_revenue_newest": lambda t: items.top_items(
        t.item_days(t.newest_window(30), PRICED), t.items, "revenue", period=w.WHOLE
    ),
    "top_items_by_margin": lambda t: items.top_items(t.item_days(_days(30), COSTED), t.items, "margin", AS_OF),
    "top_items_by_quantity": lambda t: items.top_items(t.item_days(_days(30), TRADE), t.items, "quantity", AS_OF),
    "top_items_active_stores": lambda t: items.top_items(
        t.item_days(_days(30), PRICED), t.items, "revenue", AS_OF, active_stores=t.stores
    ),
    "top_items_of_month": lambda t: items.top_items(
        t.item_days(w.month_of(2000, 11), PRICED), t.items, "revenue", period=w.month_of(2000, 11), k=10
    ),
    "best_margin_of_quarter": lambda t: items.top_items(
        t.item_days(w.quarter_of(2000, 4), COSTED), t.items, "margin", period=w.quarter_of(2000, 4)
    ),
    "product_summary": lambda t: items.product_summary(t.item_days(_days(30), COSTED), t.items, AS_OF),
    "slow_items": lambda t: items.slow_items(t.item_days(_days(30), TRADE), t.items, AS_OF),
    "loss_items": lambda t: items.loss_items(t.item_days(_days(30), PRICED), t.items, AS_OF),
    "loss_items_net": lambda t: items.loss_items(t.item_days(_days(30), PRICED), t.items, AS_OF, price_basis="net"),
    "unprofitable_items": lambda t: items.unprofitable_items(t.item_days(_days(30), COSTED), t.items, AS_OF),
    "unprofitable_items_gross": lambda t: items.unprofitable_items(
        t.item_days(_days(30), PRICED), t.items, AS_OF, price_basis="gross"
    ),
    "low_margin_items": lambda t: items.low_margin_items(t.item_days(_days(30), COSTED), t.items, AS_OF),
    "product_store_sales": lambda t: items.product_store_sales(
        t.item_days(w.month_of(2001, 6), COSTED), t.items, t.stores, w.month_of(2001, 6)
    ),
    # sold together, seasons, calendar
    "co_occurring_many": lambda t: bundles.co_occurring(
        t.item_days(HISTORY, TRADE), t.items, MANY_TARGETS, HISTORY, k=None, unique_keys=False
    ),
    "co_occurring": lambda t: bundles.co_occurring(t.item_days(HISTORY, TRADE), t.items, [TARGET], HISTORY),
    "seasonal_items": lambda t: _seasonal(t),
    "seasonal_bundles": lambda t: bundles.co_occurring(t.item_days(SUMMER, TRADE), t.items, _seasonal(t), SUMMER),
    "bundles_per_seasonal_item": lambda t: bundles.bundles_per_target(
        t.item_days(SUMMER, TRADE), t.items, _seasonal(t), SUMMER
    ),
    "sales_in_retail_periods": lambda t: periods.sales_in_periods(
        t.store_days(), t.stores, calendar(t.spark, periods.years_of(t.store_days(None, ())))
    ),
    "local_event_sales": lambda t: periods.local_event_sales(
        t.store_days(None, SALES), t.located_stores, calendar(t.spark, periods.years_of(t.store_days(None, ()))), CITY_PLACES
    ),
    "correlation_matrix": lambda t: baskets.correlation_matrix(t.item_days(HISTORY, ("total_quantity",)), t.items, HISTORY, top=100),
    "cross_sell": lambda t: baskets.cross_sell(t.item_days(HISTORY, ("total_quantity",)), t.items, HISTORY, least=2, basket="month"),
    # load and data checks
    "facts_per_store_day": lambda t: t.store_days(),
    "facts_per_item_day": lambda t: t.item_days(),
    "load_and_count": _load_and_count,
    "load_increment_and_count": _load_increment_and_count,
    "load_rejects_counted": _load_rejects_counted,
    "landed_item_days": _landed_items,
    "load_delta": _load_delta,
    "merged_store_days": _merged_store_days,
    "mixed_store_days": lambda t: _mixed_lake(t, "mixed", True).store_days(),
    "mixed_item_days": lambda t: _mixed_lake(t, "mixed-narrow", False).item_days(),
    "late_lines_store_days": lambda t: _late_lines(t).store_days(),
    "late_lines_item_days": lambda t: _late_lines(t).item_days(None, ITEM_MEASURES),
    "key_counts": lambda t: checks.key_counts(
        {
            "da_stores_date": (t.store_days(None, ()), KEYS["da_stores_date"]),
            "da_items_stores_date": (t.item_days(None, ()), KEYS["da_items_stores_date"]),
        }
    ),
    "load_progress": lambda t: checks.load_progress(t.item_days(None, ()), 2_500_000),
    "store_partitions": lambda t: loading.partition_sizes(t.store_days(None, ()), STORE_LAYOUT),
    "item_partitions": lambda t: loading.partition_sizes(t.item_days(None, ()), ITEM_LAYOUT),
    "rejected_facts": lambda t: loading.route(t.item_days(None, TRADE), ITEM_LAYOUT).rejected,
    "duplicate_line_keys": lambda t: loading.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"]),
    "row_counts": lambda t: checks.row_counts(
        {
            "stores": t.stores,
            "items": t.items,
            "da_stores_date": t.store_days(None, ()),
            "da_items_stores_date": t.item_days(None, ()),
        }
    ),
    "coverage": lambda t: checks.coverage(t.item_days(None, ())),
    "missing_days": lambda t: checks.missing_days(t.item_days(None, ())),
    "missing_days_of_one_store": lambda t: checks.missing_days(
        t.store_days(None, ()).join(t.stores.filter(F.col("name") == STORE).select(F.col("id").alias("store_id")), "store_id")
    ),
    "missing_days_of_one_location": lambda t: checks.missing_days(
        t.store_days(None, ()).join(t.located_stores.filter("location = 'PERU'").selectExpr("id AS store_id"), "store_id")
    ),
    "missing_days_of_one_item": lambda t: checks.missing_days(t.item_days(None, ()).filter(F.col("item_id") == TARGET)),
    "missing_ranges_by_store": lambda t: checks.missing_ranges(t.store_days(None, ())),
    "data_context": lambda t: checks.data_context(t.store_days(None, ()), t.stores, t.items),
    "active_stores": lambda t: checks.active_stores(t.stores),
    "store_list": lambda t: checks.store_list(t.stores),
    "newest_facts": lambda t: checks.newest(t.store_days(t.newest_dates(10)), ["store_id"]),
    "sample_stores": lambda t: checks.sample_rows(t.located_stores),
    "capped_result": lambda t: checks.capped(t.store_days(_days(30), SALES), ["store_id", "date"]),
    "plain_values": lambda t: checks.plain_values(t.store_days(_days(30))),
    # extensions
    "day_features": lambda t: trends.day_features(
        t.store_days((HISTORY[0] - timedelta(days=trends.FEATURE_DAYS), HISTORY[1]), NET), HISTORY
    ),
    "monthly_forecast": lambda t: trends.monthly_forecast(t.store_days((date(1999, 6, 1), date(2001, 6, 1)), NET), AS_OF),
    "forecast_error": lambda t: trends.forecast_error(t.store_days((date(1999, 3, 1), date(2001, 6, 1)), NET), date(2001, 3, 15)),
    "seasonal_forecast": lambda t: forecasts.seasonal_forecast(t.store_days((date(1997, 6, 1), date(2001, 6, 1)), NET), AS_OF),
    "rolling_errors": lambda t: forecasts.rolling_errors(t.store_days((date(1996, 6, 1), date(2001, 6, 1)), NET), AS_OF),
    "trend_alerts": lambda t: trends.trend_alerts(t.store_days((date(2001, 4, 1), date(2001, 6, 1)), NET), t.stores, AS_OF),
    "daily_anomalies": lambda t: trends.daily_anomalies(
        t.store_days((date(2001, 4, 1), date(2001, 7, 1)), NET), t.stores, w.month_of(2001, 6)
    ),
    "stale_items": lambda t: items.stale_items(t.item_days(None, ("total_quantity",)), t.items, AS_OF),
    "correlated_items": lambda t: trends.correlated_items(t.item_days(SUMMER, ("total_quantity",)), t.items, TARGET, SUMMER),
    "transfer_candidates": lambda t: trends.transfer_candidates(t.item_days(_days(90), ("total_quantity",)), t.items, t.stores, AS_OF),
    "price_elasticity": lambda t: trends.price_elasticity(t.item_days(HISTORY, TRADE), t.items, HISTORY),
    "kpi_strip": lambda t: trends.kpi_strip(t.store_days((date(2000, 1, 1), date(2001, 7, 1)), NET), t.stores, AS_OF),
    "margin_by_category": lambda t: items.margin_by_category(t.item_days(w.month_of(2001, 6), COSTED), t.items, w.month_of(2001, 6)),
    "margin_cube": lambda t: items.margin_cube(t.item_days(w.year_of(2000), COSTED), t.items, t.stores, w.year_of(2000)),
    "margin_cube_of_some": lambda t: items.margin_cube(
        t.item_days(w.quarter_of(2000, 4), COSTED), t.items, t.stores, w.quarter_of(2000, 4), store_ids=list(range(1, 6)), families=[11, 12, 23]
    ),
    "totals_of_terms": lambda t: items.totals_of_terms(t.item_days(w.year_of(2000), (*COSTED, "total_discount")), TERMS, w.year_of(2000)),
    "weekday_month_profile": lambda t: trends.weekday_month_profile(t.store_days(w.year_of(2000), NET), t.stores, w.year_of(2000)),
    "event_impact": lambda t: trends.event_impact(
        t.store_days((date(1999, 12, 18), date(2001, 1, 14)), NET), t.located_stores, _record_days(t)
    ),
    "best_weekday": lambda t: trends.best_weekday(t.store_days(_days(90), NET), t.stores, AS_OF),
}


def comparable_types(df: DataFrame) -> DataFrame:
    """Counts as BIGINT and decimals as DOUBLE, for comparison between engines."""

    def cast(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, IntegralType):
            return c.cast("bigint").alias(field.name)
        return c

    return df.select(*[cast(field) for field in df.schema.fields])
