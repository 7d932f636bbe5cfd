"""Sales in the periods of a retail calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.functions import measures as m
from daytally.functions.calendar import calendar_days
from daytally.functions.measures import columns
from daytally.operators.stores import per_day


def years_of(f: DataFrame) -> range:
    """The years the facts lie in, and the one before, whose last period may reach
    into them; two numbers from the dates alone."""
    first, last = f.agg(F.expr("min(year(date))"), F.expr("max(year(date))")).first()
    return range(0) if first is None else range(first - 1, last + 1)


def sales_in_periods(f: DataFrame, s: DataFrame, cal: DataFrame) -> DataFrame:
    """Totals per calendar event.

    The periods are unfolded to days, which turns the range condition into an
    equality. Facts are summed per day before they meet the calendar, whose
    size is fixed per year. Events without facts are left out.
    """
    daily = per_day(f, s)
    return (
        daily.join(calendar_days(cal), "date")
        .groupBy("event", "city", "start", "end")
        .agg(
            *columns(
                dias="count(*)",
                total_vendas="sum(nr_sales)",
                total_clientes="sum(nr_persons)",
                quantidade_total="sum(total_quantity)",
                vendas_sem_iva="sum(total_net)",
                vendas_com_iva="sum(total_doc)",
                media_diaria=m.mean("sum(total_net)", "sum(net_rows)"),
            )
        )
        .orderBy("start", "event")
    )


#: days of a bin in which facts and events meet; events of a city last a few days to some weeks
BIN = 16
#: stores of one place that stay together; a place with more is split
STORES_TOGETHER = 64


def placed_events(cal: DataFrame, cities: dict[str, list[str]]) -> DataFrame:
    """event, start, end, location: the calendar's events with a city, once for each place of
    the data that belongs to one of their cities."""
    known = [(city, place) for city, places in cities.items() for place in places]
    places = cal.sparkSession.createDataFrame(known, "one_city string, location string")
    named = cal.filter("city IS NOT NULL").withColumn("one_city", F.explode(F.split("city", ", ")))
    return named.join(F.broadcast(places), "one_city").select("event", "start", "end", "location").distinct()


def local_event_sales(f: DataFrame, located_stores: DataFrame, cal: DataFrame, cities: dict[str, list[str]]) -> DataFrame:
    """Totals per local event and place, from the active stores of that place.

    cities says which places of the data a city of the calendar stands for; one that
    it does not name has no sales. Both ends of an event count. Days are
    distinct days with facts, store-days the facts themselves. Events without any
    fact are left out, and so are facts without a date or a store that is listed.

    An interval join: facts go to the bin of BIN days they lie in, events to all
    bins they touch, and both meet on place and bin, where the days are compared.
    Facts are summed per place and day first. A place with many stores is split by
    store, its events repeated for each part, so that a place which holds most
    facts is many keys; the parts' sums are added up at the end.
    """
    active = located_stores.filter("status = 1").selectExpr("id AS store_id", "location")
    parts = active.groupBy("location").agg(F.expr(f"CAST(ceil(count(*) / {STORES_TOGETHER}) AS INT) AS parts"))
    stores = active.join(parts, "location").selectExpr("store_id", "location", "pmod(xxhash64(store_id), parts) AS part")
    bin_of = f"unix_date({{}}) DIV {BIN}"
    daily = (
        f.join(stores, "store_id")
        .groupBy("location", "part", "date")
        .agg(*columns(nr_sales="sum(nr_sales)", total_net="sum(total_net)", n_rows="count(*)"))
        .withColumn("bin", F.expr(bin_of.format("date")))
    )
    events = (
        placed_events(cal, cities)
        .join(parts, "location")
        .selectExpr("*", "explode(sequence(0L, parts - 1L)) AS part")
        .selectExpr("*", f"explode(sequence({bin_of.format('start')}, {bin_of.format('end')})) AS bin")
    )
    inside = daily.join(events, ["location", "part", "bin"]).filter("date BETWEEN start AND end")
    # one row per event, place and day before days are counted
    by_day = inside.groupBy("event", "location", "start", "end", "date").agg(
        *columns(nr_sales="sum(nr_sales)", total_net="sum(total_net)", n_rows="sum(n_rows)")
    )
    return (
        by_day.groupBy("event", "location", "start", "end")
        .agg(*columns(dias="count(*)", lojas_dia="sum(n_rows)", total_vendas="sum(nr_sales)", vendas_sem_iva="sum(total_net)"))
        .orderBy("start", "event", "location")
    )
