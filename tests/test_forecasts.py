"""The seasonal recurrence against a plain one, and what its errors are made of."""

import math
import random
from datetime import date

import pytest
from helpers import rows, store_days

from daytally.functions.windows import add_months
from daytally.operators.forecasts import Smoothing, monthly_series, rolling_errors, seasonal_forecast

START, OPEN = date(2020, 1, 1), date(2024, 1, 1)


def plain(series, horizon, s):
    level = sum(series[:12]) / 12
    trend = (sum(series[12:24]) / 12 - level) / 12
    season = [y - level for y in series[:12]]
    for y in series[12:]:
        new = s.level * (y - season[0]) + (1 - s.level) * (level + trend)
        trend = s.trend * (new - level) + (1 - s.trend) * trend
        season = season[1:] + [s.season * (y - new) + (1 - s.season) * season[0]]
        level = new
    return [level + h * trend + season[(h - 1) % 12] for h in range(1, horizon + 1)]


@pytest.fixture(scope="module")
def history():
    """Store 1 sells every month, with a peak in December; store 2 opened late; store 3 is all but idle."""
    rng = random.Random(2)
    first = [round(1000 + 5 * i + (400 if i % 12 == 11 else 0) + rng.uniform(-20, 20), 2) for i in range(48)]
    return {1: first, 2: [0.0] * 30 + first[30:], 3: [0.0] * 47 + [9.0]}


@pytest.fixture(scope="module")
def facts(spark, history):
    made = [(s, str(add_months(START, i)), x) for s, series in history.items() for i, x in enumerate(series) if x]
    return store_days(spark, *made, (1, "2024-01-15", 77), (1, "2019-12-31", 77))


def test_series(facts, history):
    assert {s: list(x) for s, x in rows(monthly_series(facts, OPEN, 48))} == history


@pytest.mark.parametrize("s", [Smoothing(), Smoothing(0.5, 0.1, 0.9)])
def test_forecast(facts, history, s):
    got = {(store, mes): float(x) for store, mes, x in rows(seasonal_forecast(facts, date(2024, 1, 20), 48, 14, s))}
    want = {(k, add_months(OPEN, h)): x for k, series in history.items() for h, x in enumerate(plain(series, 14, s))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=0.006) for k in want)
    assert got[1, date(2024, 12, 1)] > got[1, date(2024, 11, 1)] + 200  # the season is kept over a year ahead


def test_rolling_errors_are_those_of_each_origin(facts, history):
    got = {(o, h): (n, float(e)) for o, h, n, e in rows(rolling_errors(facts, OPEN, 48, origins=5, horizon=2))}
    want = {}
    for n in range(42, 47):
        for h in (1, 2):
            missed = [abs(x[n + h - 1] - plain(x[:n], 2, Smoothing())[h - 1]) / x[n + h - 1] for x in history.values() if x[n + h - 1]]
            want[add_months(START, n), h] = (len(missed), 100 * sum(missed) / len(missed))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=0.006) for k in want)


def test_one_scan_for_all_origins(spark, source):
    f = source.store_days((date(1996, 6, 1), date(2001, 6, 1)), ("total_net",))
    plan = rolling_errors(f, date(2001, 6, 30))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_too_little_history(facts):
    with pytest.raises(ValueError):
        seasonal_forecast(facts, OPEN, months=23)
    with pytest.raises(ValueError):
        rolling_errors(facts, OPEN, months=30, origins=6, horizon=3)
    assert rows(seasonal_forecast(facts.limit(0), OPEN)) == []
