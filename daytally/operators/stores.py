"""Store analyses over daily store facts.

Facts are summed per store id before the store list is joined, wherever the
result allows it: the join then handles one row per store and period whatever
the number of days, and its strategy is left to the optimizer, which broadcasts
the list only below its size limit. Results are named by store, so stores that
share a name are added up.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.functions import measures as m
from daytally.functions import windows as w
from daytally.functions.measures import columns, listed

SUMMED = ("nr_sales", "nr_persons", "total_quantity", "total_net", "total_doc", "total_discount")
MEAN_NET = m.mean("sum(total_net)", "count(total_net)")


def named(df: DataFrame, stores: DataFrame, active_only: bool = True) -> DataFrame:
    """Attach the store name as `loja`; keeps active stores only by default."""
    if active_only:
        stores = stores.filter("status = 1")
    return df.join(stores.selectExpr("id AS store_id", "name AS loja"), "store_id")


def per_store(facts: DataFrame, **keys: str) -> DataFrame:
    """Sums per store id and named key expressions; `n_rows` and `net_rows` count
    facts, for means."""
    present = facts.columns
    sums = {c: f"sum({c})" for c in SUMMED if c in present}
    if "total_net" in sums:
        sums["net_rows"] = "count(total_net)"
    return facts.groupBy("store_id", *columns(**keys)).agg(*columns(n_rows="count(*)", **sums))


def per_day(facts: DataFrame, s: DataFrame) -> DataFrame:
    """Sums per day over active stores. A store has one fact per day, so summing
    per store first would not shrink anything here."""
    active = s.filter("status = 1").selectExpr("id AS store_id")
    present = facts.columns
    sums = {c: f"sum({c})" for c in SUMMED if c in present}
    kept = facts.join(active, "store_id", "left_semi")
    return kept.groupBy("date").agg(*columns(n_rows="count(*)", net_rows="count(total_net)", **sums))


def again(df: DataFrame, *keys: str) -> DataFrame:
    """Add up partial sums under coarser keys."""
    summed = (*SUMMED, "n_rows", "net_rows")
    return df.groupBy(*keys).agg(*columns(**{c: f"sum({c})" for c in df.columns if c in summed}))


def sales_on(f: DataFrame, s: DataFrame, day: date, active_only: bool = True) -> DataFrame:
    """Every store's figures of one day, best first."""
    return (
        named(w.clip(f, w.inclusive(day, day)), s, active_only)
        .selectExpr(
            "loja",
            "date AS data",
            "nr_sales AS num_vendas",
            "nr_persons AS num_clientes",
            "total_quantity AS quantidade_total",
            "total_net AS vendas_sem_iva",
            "total_doc AS vendas_com_iva",
            "total_discount AS descontos",
        )
        .orderBy(F.desc_nulls_last("vendas_sem_iva"), "loja")
    )


def store_day_totals(f: DataFrame, s: DataFrame, day: date) -> DataFrame:
    """Revenue and transactions per store name on one day."""
    sums = again(named(per_store(w.clip(f, w.inclusive(day, day))), s), "loja")
    return sums.selectExpr("loja", "total_net AS vendas", "nr_sales AS num_transacoes").orderBy(
        F.desc_nulls_last("vendas"), "loja"
    )


def day_total(f: DataFrame, day: date) -> DataFrame:
    """Revenue of one day over all stores; one row even without facts."""
    return w.clip(f, w.inclusive(day, day)).agg(F.sum("total_net").alias("vendas"))


def period_total(f: DataFrame, s: DataFrame, label: str, first: date, last: date) -> DataFrame:
    """One row of totals over an inclusive period. The daily mean is over
    store-days."""
    daily = per_day(w.clip(f, w.inclusive(first, last)), s)
    return daily.agg(
        F.lit(label).alias("periodo"),
        *columns(
            dias="count(*)",
            total_vendas="sum(nr_sales)",
            total_clientes="sum(nr_persons)",
            quantidade_total="sum(total_quantity)",
            vendas_sem_iva="sum(total_net)",
            vendas_com_iva="sum(total_doc)",
            media_diaria=m.mean("sum(total_net)", "sum(net_rows)"),
        ),
    )


def period_by_store(f: DataFrame, s: DataFrame, first: date, last: date, customers: bool = False) -> DataFrame:
    """Revenue, sales and average ticket per store over an inclusive period;
    customers too where asked for."""
    sums = again(named(per_store(w.clip(f, w.inclusive(first, last))), s), "loja")
    return sums.selectExpr(
        "loja",
        "total_net AS vendas",
        "nr_sales AS num_vendas",
        *(["nr_persons AS num_clientes"] if customers else []),
        f"{m.ticket()} AS ticket_medio",
    ).orderBy(F.desc_nulls_last("vendas"), "loja")


def store_history(f: DataFrame, s: DataFrame, name: str, as_of: date, days: int = 30) -> DataFrame:
    """One store's daily figures, newest first; also for an inactive store."""
    return (
        named(w.trailing(f, as_of, days), s.filter(F.col("name") == name), active_only=False)
        .selectExpr(
            "loja",
            "date AS data",
            "nr_sales AS vendas",
            "nr_persons AS clientes",
            "total_net AS receita",
            "total_discount AS descontos",
        )
        .orderBy(F.desc("data"))
    )


def ytd_by_store(f: DataFrame, s: DataFrame, as_of: date) -> DataFrame:
    """Year to date per store."""
    sums = again(named(per_store(w.clip(f, w.date_window("this_year", as_of))), s), "loja")
    return sums.selectExpr(
        "loja",
        "n_rows AS dias_operacao",
        "nr_sales AS total_vendas",
        "nr_persons AS total_clientes",
        "total_net AS receita_total",
        f"{m.mean('total_net', 'net_rows')} AS media_diaria",
        f"{m.ticket()} AS ticket_medio",
    ).orderBy(F.desc_nulls_last("receita_total"), "loja")


def annual_by_store(f: DataFrame, s: DataFrame, as_of: date, years: int = 5) -> DataFrame:
    """Totals per store and calendar year over the trailing years."""
    by_year = per_store(w.clip(f, w.trailing_years(as_of, years)), ano="year(date)")
    return (
        again(named(by_year, s), "loja", "ano")
        .selectExpr(
            "loja",
            "ano",
            "total_net AS vendas_anuais",
            "nr_sales AS num_vendas",
            "nr_persons AS num_clientes",
            f"{m.mean('total_net', 'net_rows')} AS media_diaria",
        )
        .orderBy("loja", "ano")
    )


def store_ranking(f: DataFrame, s: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Stores by revenue over the trailing days. Days of operation are distinct
    dates per store name, so facts are joined before they are grouped; a store
    has at most one fact per day."""
    return (
        named(w.trailing(f, as_of, days), s)
        .groupBy("loja")
        .agg(
            *columns(
                dias_operacao="count(DISTINCT date)",
                receita_total="sum(total_net)",
                receita_media_dia=MEAN_NET,
                total_vendas="sum(nr_sales)",
                ticket_medio=m.ticket("sum(total_net)", "sum(nr_sales)"),
                total_clientes="sum(nr_persons)",
                vendas_por_cliente=m.mean("sum(nr_sales)", "sum(nr_persons)"),
            )
        )
        .orderBy(F.desc_nulls_last("receita_total"), "loja")
    )


def weekly_trend(f: DataFrame, s: DataFrame, as_of: date, weeks: int = 12) -> DataFrame:
    """Totals per week (from Monday), newest first."""
    weekly = named(per_store(w.trailing(f, as_of, 7 * weeks), semana="CAST(date_trunc('week', date) AS DATE)"), s)
    return (
        weekly.groupBy("semana")
        .agg(
            *columns(
                lojas_ativas="count(*)",  # one row per store and week here
                total_vendas="sum(nr_sales)",
                total_clientes="sum(nr_persons)",
                receita_total="sum(total_net)",
                media_diaria=m.mean("sum(total_net)", "sum(net_rows)"),
            )
        )
        .orderBy(F.desc("semana"))
    )


def weekday_profile(f: DataFrame, s: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Totals per weekday, Sunday = 0."""
    facts = w.trailing(f, as_of, days)
    by_day = per_store(facts, dia_semana="date_format(date, 'EEEE')", dia_num="dayofweek(date) - 1")
    return (
        again(named(by_day, s), "dia_semana", "dia_num")
        .selectExpr(
            "dia_semana",
            "dia_num",
            "n_rows AS ocorrencias",
            "total_net AS receita_total",
            f"{m.mean('total_net', 'net_rows')} AS receita_media",
            "nr_sales AS total_vendas",
            "nr_persons AS total_clientes",
        )
        .orderBy("dia_num")
    )


def top_stores(f: DataFrame, s: DataFrame, window: w.Window, k: int = 5) -> DataFrame:
    """The k stores with most revenue in a window."""
    sums = again(named(per_store(w.clip(f, window)), s), "loja")
    return sums.selectExpr("loja", "total_net AS receita").orderBy(F.desc_nulls_last("receita"), "loja").limit(k)


def stores_averaging_above(
    f: DataFrame, s: DataFrame, threshold: float = 1000, window: w.Window | None = None
) -> DataFrame:
    """Stores whose mean daily revenue exceeds a threshold."""
    sums = again(named(per_store(w.clip(f, window)), s), "loja")
    return (
        sums.filter(f"{m.ratio('total_net', 'net_rows')} > {threshold}")
        .selectExpr("loja", f"{m.mean('total_net', 'net_rows')} AS media_diaria")
        .orderBy(F.desc("media_diaria"), "loja")
    )


def window_totals(f: DataFrame, s: DataFrame, as_of: date) -> DataFrame:
    """Totals of every named window relative to as_of, in one scan.

    Each day goes to the windows that hold it; there is a fixed number of
    windows, and facts are summed per day beforehand.
    """
    spans = {name: w.date_window(name, as_of) for name in w.WINDOW_NAMES}
    hull = min(lo for lo, _ in spans.values()), max(hi for _, hi in spans.values())
    holds = ", ".join(f"CASE WHEN {w.in_window(span)} THEN '{name}' END" for name, span in spans.items())
    daily = per_day(w.clip(f, hull), s)
    return (
        daily.withColumn("janela", F.expr(f"explode(array_compact(array({holds})))"))
        .groupBy("janela")
        .agg(*columns(dias="count(*)", total_vendas="sum(nr_sales)", receita_total="sum(total_net)"))
    )


def daily_sales(f: DataFrame, s: DataFrame, window: w.Window) -> DataFrame:
    """Totals per day over active stores."""
    daily = per_day(w.clip(f, window), s)
    return daily.selectExpr(
        "date AS data", "n_rows AS lojas", "nr_sales AS total_vendas", "total_net AS receita_total"
    ).orderBy("data")


def monthly_sales(f: DataFrame, s: DataFrame, year: int) -> DataFrame:
    """Totals per month of a year over active stores."""
    months = per_store(w.clip(f, w.year_of(year)), mes="month(date)")
    return (
        again(named(months, s), "mes")
        .selectExpr(
            "mes", "nr_sales AS total_vendas", "total_net AS receita_total", f"{m.ticket()} AS ticket_medio"
        )
        .orderBy("mes")
    )


def worst_days(f: DataFrame, s: DataFrame, window: w.Window, k: int = 5) -> DataFrame:
    """The k days with least revenue in a window."""
    return daily_sales(f, s, window).orderBy(F.asc_nulls_last("receita_total"), "data").limit(k)


def season_comparison(
    f: DataFrame,
    s: DataFrame,
    window: w.Window,
    summer: tuple[int, ...] = (6, 7, 8),
    winter: tuple[int, ...] = (12, 1, 2),
) -> DataFrame:
    """Revenue per store in summer and winter months, and the difference."""
    in_season = w.clip(f, window).filter(F.month("date").isin(*summer, *winter))
    sums = in_season.groupBy("store_id").agg(
        *columns(
            verao=m.sum_where(f"month(date) IN ({listed(summer)})"),
            inverno=m.sum_where(f"month(date) IN ({listed(winter)})"),
        )
    )
    both = named(sums, s).groupBy("loja").agg(*columns(verao="sum(verao)", inverno="sum(inverno)"))
    return both.withColumn("variacao_pct", F.expr(m.growth("verao", "inverno"))).orderBy("loja")
