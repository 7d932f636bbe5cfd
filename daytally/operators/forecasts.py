"""Forecasts with level, trend and season, and how they would have done in the past.

An extension with definitions of our own. Each store's months are one array, and
the recurrence runs over it as a fold inside the executor: one shuffle of daily
facts to their stores and months, no Python, nothing on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.functions import measures as m
from daytally.functions import windows as w
from daytally.functions.measures import columns

YEAR = 12


@dataclass(frozen=True)
class Smoothing:
    """How much of each month's surprise goes into level, trend and season."""

    level: float = 0.2
    trend: float = 0.02
    season: float = 0.2


def monthly_series(f: DataFrame, first_open: date, months: int) -> DataFrame:
    """store_id, series: a store's revenue in each of the `months` months before first_open,
    the oldest first; a month without facts is zero. Stores without any are left out."""
    start = w.add_months(first_open, -months)
    zero = start.year * 12 + start.month
    monthly = (
        w.clip(f, (start, first_open))
        .groupBy("store_id", F.expr(f"CAST(year(date) * 12 + month(date) - {zero} AS INT) AS i"))
        .agg(*columns(net="CAST(coalesce(CAST(sum(total_net) AS DECIMAL(28,5)), 0) AS DOUBLE)"))
    )
    held = monthly.groupBy("store_id").agg(F.expr("map_from_entries(collect_list(struct(i, net))) AS held"))
    return held.selectExpr("store_id", f"transform(sequence(0, {months - 1}), i -> coalesce(held[i], 0D)) AS series")


def _state(n: str, s: Smoothing) -> str:
    """Level, trend and the coming twelve months' seasons after the first n months of `series`.

    The first year gives the level and the seasons, its difference to the second
    one the trend. From the second year on each month corrects all three; the
    season at the head of the array is the one of the month that comes next.
    """

    def mean(first: int) -> str:
        return f"(aggregate(slice(series, {first}, {YEAR}), 0D, (a, y) -> a + y) / {YEAR})"

    start = (
        f"named_struct('level', {mean(1)}, 'trend', ({mean(YEAR + 1)} - {mean(1)}) / {YEAR}, "
        f"'season', transform(slice(series, 1, {YEAR}), y -> y - {mean(1)}))"
    )
    level = f"{s.level}D * (y - s.season[0]) + {1 - s.level}D * (s.level + s.trend)"
    step = (
        f"transform(array({level}), l -> named_struct('level', l, 'trend', {s.trend}D * (l - s.level) + {1 - s.trend}D * s.trend, "
        f"'season', concat(slice(s.season, 2, {YEAR - 1}), array({s.season}D * (y - l) + {1 - s.season}D * s.season[0]))))[0]"
    )
    return f"aggregate(slice(series, {YEAR + 1}, {n} - {YEAR}), {start}, (s, y) -> {step})"


def _ahead(h: str) -> str:
    return f"(state.level + {h} * state.trend + state.season[CAST(({h} - 1) % {YEAR} AS INT)])"


def seasonal_forecast(f: DataFrame, as_of: date, months: int = 48, horizon: int = 3, s: Smoothing = Smoothing()) -> DataFrame:
    """Revenue per store for the months after the last complete one, with additive level,
    trend and season smoothed over the `months` months before.

    Months without facts count as zero, so a store that opened late starts from
    zero. Two years of months are the least; a store needs no fact in all of them.
    """
    _check(months, horizon)
    first_open = as_of.replace(day=1)
    states = monthly_series(f, first_open, months).selectExpr("store_id", f"{_state(str(months), s)} AS state")
    ahead = states.selectExpr("store_id", "state", f"explode(sequence(1, {horizon})) AS h")
    return ahead.selectExpr("store_id", f"add_months(DATE'{first_open}', h - 1) AS mes", f"{m.rounded(_ahead('h'))} AS previsao")


def rolling_errors(
    f: DataFrame, as_of: date, months: int = 60, origins: int = 12, horizon: int = 3, s: Smoothing = Smoothing()
) -> DataFrame:
    """Mean absolute percentage error of `seasonal_forecast` for every origin and month ahead:
    as if it had been made at each of the last `origins` months from which `horizon`
    months are known by now.

    All origins come from one pass over the facts: a store's array is repeated once per
    origin, and each copy is folded as far as that origin had seen. Months of zero
    revenue have no percentage and do not count. origem is the first month forecast.
    """
    _check(months - horizon - origins + 1, horizon)
    first_open = as_of.replace(day=1)
    start = w.add_months(first_open, -months)
    cut = monthly_series(f, first_open, months).selectExpr(
        "series", f"explode(sequence({months - horizon - origins + 1}, {months - horizon})) AS n"
    )
    states = cut.selectExpr("series", "n", f"{_state('n', s)} AS state")
    ahead = states.selectExpr("series", "n", "state", f"explode(sequence(1, {horizon})) AS h")
    scored = ahead.selectExpr("n", "h", "series[n + h - 1] AS net", f"{_ahead('h')} AS previsao").filter("net > 0")
    miss = "CAST(abs(net - previsao) / net AS DECIMAL(20,10))"
    return (
        scored.groupBy("n", "h")
        .agg(*columns(lojas="count(*)", mape_pct=m.rounded(f"{m.average(miss)} * 100")))
        .selectExpr(f"add_months(DATE'{start}', n) AS origem", "CAST(h AS BIGINT) AS horizonte", "lojas", "mape_pct")
        .orderBy("origem", "horizonte")
    )


def _check(months: int, horizon: int) -> None:
    if months < 2 * YEAR or horizon < 1:
        raise ValueError("two years of months and a horizon of one month are the least")
