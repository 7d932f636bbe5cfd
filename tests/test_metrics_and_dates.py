from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daytally.functions import calendar as cal
from daytally.functions import measures as m
from daytally.functions import windows as w


def one(spark, sql, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(F.expr(sql)).first()[0]


def test_ratio_of_zero_is_null(spark):
    assert one(spark, m.ratio("a", "b"), a=5, b=0) is None
    assert one(spark, m.percent("a", "b"), a=5, b=0) is None


@pytest.mark.parametrize("value, expected", [(1.005, "1.01"), (-1.005, "-1.01"), (2.675, "2.68"), (0.125, "0.13")])
def test_rounding_goes_away_from_zero(spark, value, expected):
    assert one(spark, m.rounded("a"), a=value) == Decimal(expected)


def test_margin_needs_a_cost(spark):
    amounts = {"total_net": Decimal("100"), "total_quantity": Decimal("2")}
    assert one(spark, m.MARGIN, latest_price_cost=Decimal("30"), **amounts) == 40
    df = spark.sql("select 100.0bd total_net, 2.0bd total_quantity, cast(null as decimal(18,5)) latest_price_cost")
    assert df.select(F.expr(m.MARGIN)).first()[0] is None


def test_growth(spark):
    assert one(spark, m.growth("new", "old"), new=150, old=100) == 50
    assert one(spark, m.growth("new", "old"), new=150, old=0) is None


def test_spoken_terms(spark):
    df = spark.sql("select 100.0bd total_net, 2.0bd total_quantity, 30.0bd latest_price_cost, 7 nr_sales")
    got = df.select(*[F.expr(m.measure(term)) for term in ("Vendas", "receita", "Margem", "Tiquets")]).first()
    assert tuple(got) == (100, 100, 40, 7)
    with pytest.raises(KeyError):
        m.measure("stock")


AS_OF = date(2001, 6, 30)


@pytest.mark.parametrize(
    "name, lo, hi",
    [
        ("today", date(2001, 6, 30), date(2001, 7, 1)),
        ("yesterday", date(2001, 6, 29), date(2001, 6, 30)),
        ("this_week", date(2001, 6, 25), date(2001, 7, 1)),
        ("this_month", date(2001, 6, 1), date(2001, 7, 1)),
        ("this_year", date(2001, 1, 1), date(2001, 7, 1)),
        ("last_month", date(2001, 5, 1), date(2001, 6, 1)),
        ("last_year", date(2000, 1, 1), date(2001, 1, 1)),
    ],
)
def test_named_windows(name, lo, hi):
    assert w.date_window(name, AS_OF) == (lo, hi)


def test_month_arithmetic():
    assert w.add_months(date(2000, 2, 29), -12) == date(1999, 2, 28)
    assert w.add_months(date(2001, 1, 31), 1) == date(2001, 2, 28)
    assert w.add_months(date(2001, 1, 15), -1) == date(2000, 12, 15)
    assert w.month_of(2000, 12) == (date(2000, 12, 1), date(2001, 1, 1))
    assert w.quarter_of(2000, 4) == (date(2000, 10, 1), date(2001, 1, 1))


# published dates: carnival, Good Friday, Easter Sunday, Corpus Christi
FEASTS = {
    2020: ("2020-02-25", "2020-04-10", "2020-04-12", "2020-06-11"),
    2021: ("2021-02-16", "2021-04-02", "2021-04-04", "2021-06-03"),
    2022: ("2022-03-01", "2022-04-15", "2022-04-17", "2022-06-16"),
    2023: ("2023-02-21", "2023-04-07", "2023-04-09", "2023-06-08"),
    2024: ("2024-02-13", "2024-03-29", "2024-03-31", "2024-05-30"),
    2025: ("2025-03-04", "2025-04-18", "2025-04-20", "2025-06-19"),
}


def test_moveable_feasts(spark):
    found = {}
    for r in cal.calendar(spark, FEASTS).filter("kind = 'feast'").collect():
        found.setdefault(r.year, {})[r.event] = r.start.isoformat()
    for year, dates in FEASTS.items():
        events = found[year]
        assert (events["Carnaval"], events["Sexta-feira Santa"], events["Páscoa"], events["Corpo de Deus"]) == dates


def test_easter_over_four_centuries(spark):
    """Against the anonymous Gregorian rule, year by year."""

    def easter(year):
        a, b, c = year % 19, year // 100, year % 100
        h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
        k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
        n = (a + 11 * h + 22 * k) // 451
        return date(year, (h + k - 7 * n + 114) // 31, (h + k - 7 * n + 114) % 31 + 1)

    got = spark.range(1900, 2300).select("id", F.expr(f"{cal.easter_sunday('CAST(id AS INT)')} AS e")).collect()
    assert [r.e for r in got] == [easter(r.id) for r in got]


def test_computed_retail_days(spark):
    days = {(r.year, r.event): (r.start, r.end) for r in cal.calendar(spark, range(2020, 2026)).collect()}
    assert days[2024, "Black Friday"][0] == date(2024, 11, 29)
    assert days[2025, "Black Friday"][0] == date(2025, 11, 28)
    assert days[2025, "Festas Gualterianas"] == (date(2025, 8, 2), date(2025, 8, 3))
    assert days[2020, "Festas Gualterianas"] == (date(2020, 8, 1), date(2020, 8, 2))
    assert days[2023, "Passagem de ano"] == (date(2023, 12, 31), date(2024, 1, 1))


def test_trailing_up_to_the_newest_date(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-03-01')) date")
    kept = w.trailing(df, None, 30)
    assert kept.agg(F.min("date"), F.max("date")).first()[:] == (date(2024, 1, 31), date(2024, 3, 1))
    # with as_of nothing later is let in
    assert w.trailing(df, date(2024, 2, 15), 30).agg(F.max("date")).first()[0] == date(2024, 2, 15)
