"""Extensions: features, forecasts, alerts and recommendations.

The catalogue's source only describes these in its plans; the definitions here
are ours. All of them are aggregates and windows per store or per item. A window
over one store holds at most one row per day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.functions import calendar as cal
from daytally.functions import measures as m
from daytally.functions import windows as w
from daytally.functions.measures import columns
from daytally.operators.items import SOLD, labelled
from daytally.operators.stores import again, named, per_day, per_store

FEATURE_DAYS = 365  # how far back a feature looks


def day_features(f: DataFrame, window: w.Window | None = None) -> DataFrame:
    """Calendar, lag and rolling-mean features of every store-day in the window.

    f holds the facts of the window and of the FEATURE_DAYS days before it. Lags look an exact number of days back and are NULL when that day has no
    fact. Rolling means cover the day and the days before it, over the days
    that have facts. All frames share one sort per store.
    """
    by_day = "PARTITION BY store_id ORDER BY unix_date(date) RANGE BETWEEN"

    def lag(days: int) -> str:
        return f"max(total_net) OVER ({by_day} {days} PRECEDING AND {days} PRECEDING)"

    def rolling(days: int) -> str:
        frame = f"OVER ({by_day} {days - 1} PRECEDING AND CURRENT ROW)"
        return m.mean(f"sum(total_net) {frame}", f"count(total_net) {frame}")

    featured = cal.with_easter(f).select(
        "store_id",
        "date",
        "total_net",
        *columns(
            day_of_week="dayofweek(date) - 1",
            month="month(date)",
            quarter="quarter(date)",
            is_weekend="CAST(dayofweek(date) IN (1, 7) AS INT)",
            is_holiday=f"CAST({cal.is_holiday()} AS INT)",
            week_of_year="weekofyear(date)",
            days_to_easter=cal.days_to_easter(),
            days_to_christmas=cal.days_to_christmas(),
            **{f"sales_lag_{n}": lag(n) for n in (7, 30, 365)},
            **{f"rolling_mean_{n}": rolling(n) for n in (7, 30)},
        ),
    )
    return featured if window is None else featured.filter(w.in_window(window))


def monthly_forecast(f: DataFrame, as_of: date, horizon: int = 3) -> DataFrame:
    """Revenue per store for the months after the last complete one.

    A month is forecast as the same month a year earlier times the growth of the
    last twelve months over the twelve before. The band adds the 10 % and 90 %
    quantiles of what that rule missed in the last twelve months. The horizon is
    twelve months at most: beyond, the month a year earlier is itself a forecast.
    """
    if not 1 <= horizon <= 12:
        raise ValueError("the horizon is 1 to 12 months")
    first_open = as_of.replace(day=1)
    last = first_open.year * 12 + first_open.month - 1
    monthly = (
        w.clip(f, (w.add_months(first_open, -24), first_open))
        .groupBy("store_id", F.expr("year(date) * 12 + month(date) AS m"))
        .agg(*columns(net="CAST(sum(total_net) AS DECIMAL(18,5))"))
    )
    recent, per_id = f"m > {last - 12}", "OVER (PARTITION BY store_id)"
    growth = m.ratio(
        f"sum(CASE WHEN {recent} THEN net END) {per_id}", f"sum(CASE WHEN NOT {recent} THEN net END) {per_id}"
    )
    year_before = "max(net) OVER (PARTITION BY store_id ORDER BY m RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING)"
    missed = f"CASE WHEN {recent} THEN CAST(net AS DOUBLE) - CAST(year_before AS DOUBLE) * growth END"
    bases = ", ".join(
        f"max(CASE WHEN m = {last - 12 + h} THEN CAST(net AS DOUBLE) * growth END)" for h in range(1, horizon + 1)
    )
    return (
        monthly.select("*", *columns(growth=growth, year_before=year_before))
        .groupBy("store_id")
        .agg(*columns(bases=f"array({bases})", low=f"percentile({missed}, 0.1)", high=f"percentile({missed}, 0.9)"))
        .selectExpr("store_id", "low", "high", "posexplode(bases) AS (ahead, base)")
        .filter("base IS NOT NULL")
        .selectExpr(
            "store_id",
            f"add_months(DATE'{first_open}', ahead) AS mes",
            f"{m.rounded('base')} AS previsao",
            f"{m.rounded('base + low')} AS minimo",
            f"{m.rounded('base + high')} AS maximo",
        )
    )


def forecast_error(f: DataFrame, as_of: date, horizon: int = 3) -> DataFrame:
    """Mean absolute percentage error of the forecast made at as_of, against the
    months that followed; all stores together."""
    start = as_of.replace(day=1)
    actual = (
        w.clip(f, (start, w.add_months(start, horizon)))
        .groupBy("store_id", F.expr("trunc(date, 'month') AS mes"))
        .agg(*columns(real="sum(total_net)"))
    )
    miss = f"CAST({m.ratio('abs(real - previsao)', 'real')} AS DECIMAL(20,10))"
    return (
        monthly_forecast(f, as_of, horizon)
        .join(actual, ["store_id", "mes"])
        .agg(*columns(meses="count(*)", mape_pct=m.rounded(f"{m.average(miss)} * 100")))
    )


def trend_alerts(f: DataFrame, s: DataFrame, as_of: date, fall: float = 15) -> DataFrame:
    """Stores whose last complete month fell by more than `fall` percent against
    the month before."""
    last = w.date_window("last_month", as_of)
    before = w.date_window("last_month", last[0])
    sums = (
        w.clip(f, (before[0], last[1]))
        .groupBy("store_id")
        .agg(*columns(mes_anterior=m.sum_where(w.in_window(before)), ultimo_mes=m.sum_where(w.in_window(last))))
    )
    return (
        named(sums, s)
        .withColumn("variacao_pct", F.expr(m.growth("ultimo_mes", "mes_anterior")))
        .filter(f"variacao_pct < {-fall}")
        .select("loja", "mes_anterior", "ultimo_mes", "variacao_pct")
        .orderBy("variacao_pct", "loja")
    )


def daily_anomalies(
    f: DataFrame, s: DataFrame, window: w.Window, days: int = 28, fall: float = 30, peak: float = 3
) -> DataFrame:
    """Store-days far from the store's preceding days.

    A day is a fall when revenue is more than `fall` percent below the mean of
    the preceding days, and a peak when it lies more than `peak` standard
    deviations above it. Facts from before the window serve as history.
    """
    lo, hi = window
    history = w.trailing_days(lo, days)[0]
    frame = f"OVER (PARTITION BY store_id ORDER BY unix_date(date) RANGE BETWEEN {days} PRECEDING AND 1 PRECEDING)"
    n = f"count(total_net) {frame}"
    # from exact sums, so that the value does not depend on row order
    scored = (
        w.clip(f, (history, hi))
        .select(
            "store_id",
            "date",
            "total_net",
            *columns(
                n=n,
                mean=m.ratio(f"sum(total_net) {frame}", n),
                square=m.ratio(f"sum(total_net * total_net) {frame}", n),
            ),
        )
        .filter(f"{w.in_window(window)} AND n > 1")
    )
    kind = (
        f"CASE WHEN CAST(total_net AS DOUBLE) < mean * {1 - fall / 100} THEN 'queda' "
        f"WHEN CAST(total_net AS DOUBLE) > mean + {peak} * sqrt(greatest(square - mean * mean, 0D)) THEN 'pico' END"
    )
    return named(scored.withColumn("tipo", F.expr(kind)).filter("tipo IS NOT NULL"), s).selectExpr(
        "loja", "date", "total_net", f"{m.rounded('mean')} AS media_anterior", "tipo"
    )


def correlated_items(g: DataFrame, i: DataFrame, target: int, window: w.Window, k: int = 20) -> DataFrame:
    """Items whose daily quantities move most with those of a target item.

    Pearson correlation over all days of the window that have facts; an item
    without sales on a day counts as zero. Each item-day meets at most one day
    of the target, so no pairs of items are formed.
    """
    facts = w.clip(g, window)
    # a row per day of the window, so its totals are taken over few rows
    days = facts.groupBy("date").agg(
        *columns(t=f"CAST(sum(CASE WHEN item_id = {int(target)} THEN total_quantity END) AS DECIMAL(18,5))")
    )
    days = days.selectExpr(
        "date",
        "t",
        "CAST(count(*) OVER () AS DOUBLE) AS n",
        "CAST(sum(t) OVER () AS DOUBLE) AS y",
        "CAST(sum(t * t) OVER () AS DOUBLE) AS yy",
    )
    sums = (
        facts.filter(F.col("item_id") != target)
        .groupBy("item_id", "date")
        .agg(*columns(q="CAST(sum(total_quantity) AS DECIMAL(18,5))"))
        .join(F.broadcast(days), "date")  # at most one row per day of the window
        .groupBy("item_id")
        .agg(
            *columns(
                x="CAST(sum(q) AS DOUBLE)",
                xx="CAST(sum(q * q) AS DOUBLE)",
                xy="coalesce(CAST(sum(q * t) AS DOUBLE), 0D)",
                n="max(n)",
                y="max(y)",
                yy="max(yy)",
            )
        )
    )
    spread = "nullif(sqrt((n * xx - x * x) * (n * yy - y * y)), 0D)"
    scored = sums.withColumn("correlacao", F.expr(m.rounded(f"(n * xy - x * y) / {spread}", 4)))
    best = labelled(scored, i).orderBy(F.desc_nulls_last("correlacao"), "item_id").limit(k)
    return best.selectExpr("artigo", "codigo", "x AS qtd_vendida", "correlacao")


def price_elasticity(g: DataFrame, i: DataFrame, window: w.Window, min_days: int = 10) -> DataFrame:
    """Slope of ln(quantity) on ln(unit price) per item, over store-days.

    Logarithms are kept to eight decimals and summed exactly.
    """
    price = m.ratio("total_net", "total_quantity")
    logs = (
        w.clip(g, window)
        .filter(f"{SOLD} AND total_net > 0")
        .selectExpr(
            "item_id",
            f"CAST(ln({price}) AS DECIMAL(12,8)) AS p",
            "CAST(ln(CAST(total_quantity AS DOUBLE)) AS DECIMAL(12,8)) AS q",
        )
    )
    sums = logs.groupBy("item_id").agg(
        *columns(
            dias="count(*)",
            sp="CAST(sum(p) AS DOUBLE)",
            sq="CAST(sum(q) AS DOUBLE)",
            spq="CAST(sum(p * q) AS DOUBLE)",
            spp="CAST(sum(p * p) AS DOUBLE)",
        )
    )
    spread = "(dias * spp - sp * sp)"
    slope = f"CASE WHEN {spread} > 0.000001 THEN (dias * spq - sp * sq) / {spread} END"
    return labelled(sums.filter(f"dias >= {min_days}"), i).selectExpr(
        "artigo", "codigo", "dias", f"{m.rounded(slope, 4)} AS elasticidade"
    )


def transfer_candidates(
    g: DataFrame, i: DataFrame, s: DataFrame, as_of: date, days: int = 90, share: float = 0.1
) -> DataFrame:
    """Items that sell in one store at most a share of what they sell in their
    best store: stock could move from the slow to the best store."""
    active = s.filter("status = 1")
    sums = (
        w.trailing(g, as_of, days)
        .filter(SOLD)
        .groupBy("item_id", "store_id")
        .agg(*columns(qtd="sum(total_quantity)"))
        .join(active.selectExpr("id AS store_id"), "store_id", "left_semi")
    )
    # the lowest store id among equal quantities
    best = sums.groupBy("item_id").agg(F.expr("max(struct(qtd, -store_id AS minus_id)) AS best"))
    slow = sums.join(best, "item_id").filter(f"CAST(qtd AS DOUBLE) <= {share} * CAST(best.qtd AS DOUBLE)")
    return (
        labelled(slow.selectExpr("*", "-best.minus_id AS best_id", "best.qtd AS qtd_melhor"), i)
        .join(active.selectExpr("id AS store_id", "name AS de_loja"), "store_id")
        .join(active.selectExpr("id AS best_id", "name AS para_loja"), "best_id")
        .select("artigo", "codigo", "de_loja", "qtd", "para_loja", "qtd_melhor")
    )


def kpi_strip(f: DataFrame, s: DataFrame, as_of: date) -> DataFrame:
    """One row: today, month and year to date, the same days a year earlier, and
    month to date against the month before."""
    month, year = w.date_window("this_month", as_of), w.date_window("this_year", as_of)
    year_ago = tuple(w.add_months(d, -12) for d in year)
    month_ago = tuple(w.add_months(d, -1) for d in month)
    spans = {
        "hoje": w.date_window("today", as_of),
        "mes": month,
        "ano": year,
        "mes_anterior": month_ago,
        "ano_anterior": year_ago,
    }
    hull = min(lo for lo, _ in spans.values()), year[1]
    daily = per_day(w.clip(f, hull), s)
    sums = {name: f"coalesce({m.sum_where(w.in_window(span))}, 0)" for name, span in spans.items()}
    changes = columns(mom_pct=m.growth("mes", "mes_anterior"), yoy_pct=m.growth("ano", "ano_anterior"))
    return daily.agg(*columns(**sums)).select("*", *changes)


def weekday_month_profile(f: DataFrame, s: DataFrame, window: w.Window) -> DataFrame:
    """Mean store-day revenue per weekday (Sunday = 0) and month."""
    by_cell = per_store(w.clip(f, window), dia_num="dayofweek(date) - 1", mes="month(date)")
    return again(named(by_cell, s), "dia_num", "mes").selectExpr(
        "dia_num", "mes", "total_net AS receita_total", f"{m.mean('total_net', 'net_rows')} AS receita_media"
    )


def best_weekday(f: DataFrame, s: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Each store's weekday with the highest mean revenue."""
    sums = again(named(per_store(w.trailing(f, as_of, days), dia_num="dayofweek(date) - 1"), s), "loja", "dia_num")
    best = f"max(struct({m.mean('total_net', 'net_rows')} AS receita_media, -dia_num AS minus)) AS best"
    return (
        sums.groupBy("loja")
        .agg(F.expr(best))
        .selectExpr("loja", "-best.minus AS dia_num", "best.receita_media AS receita_media")
        .orderBy("loja")
    )


def event_impact(f: DataFrame, located_stores: DataFrame, events: DataFrame, days: int = 14) -> DataFrame:
    """Revenue of the stores at an event's location before and after it.

    events: event, location, day. Sums cover the `days` days before the day and
    the same number from it on. Each event is unfolded to its 2 * days dates,
    which turns the range condition into an equality; facts are summed per
    location and day first.
    """
    places = located_stores.filter("status = 1").selectExpr("id AS store_id", "location")
    daily = f.join(places, "store_id").groupBy("location", "date").agg(*columns(total_net="sum(total_net)"))
    around = events.selectExpr(
        "event", "location", "day", f"explode(sequence({-days}, {days - 1})) AS offset"
    ).withColumn("date", F.expr("date_add(day, offset)"))
    return (
        around.join(daily, ["location", "date"], "left")
        .groupBy("event", "location", "day")
        .agg(
            *columns(
                antes=m.sum_where("offset < 0 AND total_net IS NOT NULL"),
                depois=m.sum_where("offset >= 0 AND total_net IS NOT NULL"),
            )
        )
        .withColumn("variacao_pct", F.expr(m.growth("depois", "antes")))
    )
