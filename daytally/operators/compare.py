"""Comparison of periods, over all stores or like for like."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.functions import measures as m
from daytally.functions import windows as w
from daytally.functions.measures import columns
from daytally.operators.stores import named


def _hull(*periods: w.Window) -> w.Window:
    return min(lo for lo, _ in periods), max(hi for _, hi in periods)


def comparable_stores(f: DataFrame, periods: list[w.Window]) -> DataFrame:
    """Ids of the stores with facts in every one of the periods, in one scan."""
    counts = {f"n{i}": f"count_if({w.in_window(p)})" for i, p in enumerate(periods)}
    seen = w.clip(f, _hull(*periods)).groupBy("store_id").agg(*columns(**counts))
    return seen.filter(" AND ".join(f"{n} > 0" for n in counts)).select("store_id")


def compare(
    f: DataFrame,
    s: DataFrame,
    period_a: w.Window,
    period_b: w.Window,
    scope: str = "all",
    active_only: bool = True,
    since: date | None = None,
    until: date | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Revenue per store in two periods, and growth from a to b in percent.

    scope "lfl" keeps stores active in both periods (like for like). scope "all"
    keeps every store with a fact in the table, or between `since` and `until`
    where given, or in `known` (store_id), also those without revenue in either period. Both periods are
    summed in one pass, so that there is neither a self-join nor a second scan.
    """
    a, b = w.in_window(period_a), w.in_window(period_b)
    if scope == "lfl":
        f = w.clip(f, _hull(period_a, period_b)).filter(f"{a} OR {b}")
    elif since is not None:
        f = w.clip(f, (since, until or max(period_a[1], period_b[1])))
    per_id = f.groupBy("store_id").agg(
        *columns(
            revenue_a=m.sum_where(a), revenue_b=m.sum_where(b), in_a=f"count_if({a})", in_b=f"count_if({b})"
        )
    )
    if known is not None:
        per_id = known.join(per_id, "store_id", "left").fillna(0)
    if scope == "lfl":
        per_id = per_id.filter("in_a > 0 and in_b > 0")
    return (
        named(per_id, s, active_only)
        .groupBy(F.col("loja").alias("name"))
        .agg(*columns(revenue_a="sum(revenue_a)", revenue_b="sum(revenue_b)"))
        .withColumn("growth_pct", F.expr(m.growth("revenue_b", "revenue_a")))
        .orderBy(F.desc_nulls_last("growth_pct"), "name")
    )


def yoy_by_store(
    f: DataFrame,
    s: DataFrame,
    as_of: date,
    active_only: bool = True,
    since: date | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """This year so far against the whole of last year, per store.

    f need only hold the two years when `known` (store_id) names the stores that
    have facts at any time; those without any in the two years show no revenue.
    """
    last, this = w.date_window("last_year", as_of), w.date_window("this_year", as_of)
    return (
        compare(f, s, last, this, active_only=active_only, since=since, known=known)
        .selectExpr(
            "name AS loja",
            "revenue_b AS vendas_este_ano",
            "revenue_a AS vendas_ano_passado",
            "growth_pct AS variacao_percentual",
        )
        .orderBy(F.desc("vendas_este_ano"), "loja")
    )


def yoy_monthly(f: DataFrame, s: DataFrame, as_of: date, years_back: int = 2) -> DataFrame:
    """Each month up to the current one: this year, last year, difference, %.

    A month seen only in an earlier year of the span appears with zeros.
    """
    span = w.clip(f, w.trailing_years(as_of, years_back)).filter(f"month(date) <= {as_of.month}")
    per_id = span.groupBy("store_id", F.expr("month(date) AS mes")).agg(
        *columns(
            vendas_ano=m.sum_where(f"year(date) = {as_of.year}"),
            vendas_ano_anterior=m.sum_where(f"year(date) = {as_of.year - 1}"),
        )
    )
    return (
        named(per_id, s)
        .groupBy("loja", "mes")
        .agg(*columns(vendas_ano="sum(vendas_ano)", vendas_ano_anterior="sum(vendas_ano_anterior)"))
        .select(
            "*",
            *columns(
                diferenca="round(vendas_ano - vendas_ano_anterior, 2)",
                variacao_pct=m.growth("vendas_ano", "vendas_ano_anterior"),
            ),
        )
        .orderBy("loja", "mes")
    )
