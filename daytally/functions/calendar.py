"""Retail calendar of Portugal: public holidays, moveable feasts, retail periods."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
FIXED_HOLIDAYS = [
    (1, 1, "Ano Novo"),
    (4, 25, "Dia da Liberdade"),
    (5, 1, "Dia do Trabalhador"),
    (6, 10, "Dia de Portugal"),
    (8, 15, "Assunção de Nossa Senhora"),
    (10, 5, "Implantação da República"),
    (11, 1, "Dia de Todos os Santos"),
    (12, 1, "Restauração da Independência"),
    (12, 8, "Imaculada Conceição"),
    (12, 25, "Natal"),
]

# name, days from Easter Sunday to the first and to the last day
EASTER_PERIODS = [
    ("Carnaval", -47, -47),
    ("Sexta-feira Santa", -2, -2),
    ("Páscoa", 0, 0),
    ("Semana da Páscoa", -2, 1),
    ("Corpo de Deus", 60, 60),
]

# name, city, first (month, day), last (month, day), impact
RETAIL_PERIODS = [
    ("São João", "Porto, Braga", (6, 23), (6, 24), "HIGH"),
    ("São João (pico)", "Porto, Braga", (6, 20), (6, 25), "HIGH"),
    ("Romaria de São Bartolomeu", "Ponte de Lima", (8, 19), (8, 24), "MEDIUM"),
    ("Feira de São Mateus", "Viseu", (8, 1), (9, 30), "LOW"),
    ("Regresso às aulas", None, (9, 1), (9, 15), "HIGH"),
    ("Semana da Black Friday", None, (11, 25), (12, 1), "HIGH"),
    ("Época de Natal", None, (12, 1), (12, 24), "HIGHEST"),
    ("Véspera e dia de Natal", None, (12, 24), (12, 25), "HIGHEST"),
    ("Passagem de ano", None, (12, 31), (1, 1), None),
]
# ----------------------------------------------------------------------------


def easter_sunday(year: str) -> str:
    """Gregorian Easter of a year expression, in integer SQL arithmetic.

    Works on the age of the moon: the golden number gives the epact, the epact
    gives the days from 1 March to the paschal full moon, and Easter is the
    Sunday strictly after that moon.
    """
    century = f"(({year}) DIV 100 + 1)"
    golden = f"(({year}) % 19 + 1)"
    solar = f"(3 * {century} DIV 4 - 12)"
    lunar = f"((8 * {century} + 5) DIV 25 - 5)"
    epact = f"pmod(11 * {golden} + 20 + {lunar} - {solar}, 30)"
    # the calendar never lets two moons of one cycle share the last day
    late = f"({epact} = 24 OR ({epact} = 25 AND {golden} > 11))"
    age = f"({epact} + CAST({late} AS INT))"
    # days after 1 March, at the earliest 21 March
    moon = f"(CASE WHEN {age} > 23 THEN 73 ELSE 43 END - {age})"
    return f"next_day(date_add(make_date({year}, 3, 1), CAST({moon} AS INT)), 'SUN')"


def last_friday_of_november(year: str) -> str:
    return f"next_day(make_date({year}, 11, 23), 'FRI')"


def first_weekend_of_august(year: str) -> str:
    """Saturday of the first full weekend."""
    return f"next_day(make_date({year}, 7, 31), 'SAT')"


def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


def _period(kind: str, event: str, city: str | None, start: str, end: str, impact: str | None) -> str:
    return (
        f"named_struct('kind', '{kind}', 'event', '{event}', 'city', {_text(city)}, "
        f"'start', {start}, 'end', {end}, 'impact', {_text(impact)})"
    )


def calendar(spark: SparkSession, years: Iterable[int]) -> DataFrame:
    """One row per year and event: year, kind, event, city, start, end, impact.

    Both ends are inclusive. The table has a fixed number of rows per year.
    """

    def day(month: int, dom: int, year: str = "year") -> str:
        return f"make_date({year}, {month}, {dom})"

    rows = [_period("holiday", name, None, day(month, dom), day(month, dom), None) for month, dom, name in FIXED_HOLIDAYS]
    rows += [
        _period("feast", name, None, f"date_add(easter, {first})", f"date_add(easter, {last})", None)
        for name, first, last in EASTER_PERIODS
    ]
    for name, city, first, last, impact in RETAIL_PERIODS:
        end = day(*last, year="year + 1" if last < first else "year")
        rows.append(_period("retail", name, city, day(*first), end, impact))
    saturday, friday = first_weekend_of_august("year"), last_friday_of_november("year")
    rows.append(_period("retail", "Festas Gualterianas", "Guimarães", saturday, f"date_add({saturday}, 1)", "MEDIUM"))
    rows.append(_period("retail", "Black Friday", None, friday, friday, "HIGH"))
    listed_years = ", ".join(str(int(y)) for y in sorted(set(years)))
    return (
        spark.range(1)
        .selectExpr(f"explode(CAST(array({listed_years}) AS ARRAY<INT>)) AS year")
        .selectExpr("year", f"{easter_sunday('year')} AS easter")
        .selectExpr("year", f"inline(array({', '.join(rows)}))")
    )


def calendar_days(cal: DataFrame) -> DataFrame:
    """The calendar with one row per day of each event."""
    return cal.selectExpr("*", "explode(sequence(start, end)) AS date")


def with_easter(df: DataFrame, day: str = "date") -> DataFrame:
    """Adds `easter` and `next_easter`, those of the day's year and of the year
    after, from a table of the Gregorian calendar's years up to 2999; a day beyond
    them is an error. The rule runs once per year instead of once per row."""
    years = (
        df.sparkSession.range(1583, 3000)
        .selectExpr("CAST(id AS INT) AS easter_year")
        .selectExpr(
            "easter_year",
            f"{easter_sunday('easter_year')} AS easter",
            f"{easter_sunday('easter_year + 1')} AS next_easter",
        )
    )
    known = F.when(F.expr(f"{day} IS NULL OR year({day}) BETWEEN 1583 AND 2999"), F.col("easter"))
    checked = known.otherwise(F.raise_error(F.concat(F.lit("no Easter rule for "), F.col(day).cast("string"))))
    joined = df.join(F.broadcast(years), F.expr(f"year({day}) = easter_year"), "left").drop("easter_year")
    return joined.withColumn("easter", checked)


def is_holiday(day: str = "date") -> str:
    """National holiday: a fixed one, Good Friday, Easter Sunday or Corpus Christi.
    For a table made by `with_easter`."""
    fixed = ", ".join(str(month * 100 + dom) for month, dom, _ in FIXED_HOLIDAYS)
    return f"(month({day}) * 100 + day({day}) IN ({fixed}) OR datediff({day}, easter) IN (-2, 0, 60))"


def days_to_easter(day: str = "date") -> str:
    """Days until the next Easter Sunday, zero on the day itself; for a table
    made by `with_easter`."""
    return f"datediff(CASE WHEN easter >= {day} THEN easter ELSE next_easter END, {day})"


def days_to_christmas(day: str = "date") -> str:
    passed = f"CAST(month({day}) = 12 AND day({day}) > 25 AS INT)"
    return f"datediff(make_date(year({day}) + {passed}, 12, 25), {day})"
