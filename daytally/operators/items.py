"""Item analyses over daily item facts.

Facts are summed per item id first; only one row per item then meets the item
list. Item labels depend on the id alone, so the result equals a grouping by id
and labels after the join, without the labels in the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytally.functions import measures as m
from daytally.functions import windows as w
from daytally.functions.measures import columns

# Rows of goods sold; a zero or negative quantity is not a sale.
SOLD = "total_quantity > 0"
RANKED_BY = {"revenue": "receita_total", "margin": "margem_total", "quantity": "qtd_vendida"}
MARGIN_SUM = f"sum({m.MARGIN})"
MEAN_COST = m.average("latest_price_cost")

AsOf = date | Column | None


def selected(
    g: DataFrame,
    as_of: AsOf = None,
    days: int = 30,
    period: w.Window | None = None,
    active_stores: DataFrame | None = None,
) -> DataFrame:
    """Facts of a period, or else of the trailing days up to as_of or the newest
    date; of active stores only when a store list is given."""
    facts = w.clip(g, period) if period else w.trailing(g, as_of, days)
    if active_stores is not None:
        ids = active_stores.filter("status = 1").selectExpr("id AS store_id")
        facts = facts.join(ids, "store_id", "left_semi")
    return facts


def labelled(df: DataFrame, items: DataFrame) -> DataFrame:
    return df.join(items.selectExpr("id AS item_id", "description AS artigo", "pcode AS codigo"), "item_id")


def top_items(
    g: DataFrame,
    i: DataFrame,
    by: str = "revenue",
    as_of: AsOf = None,
    days: int = 30,
    period: w.Window | None = None,
    k: int = 20,
    min_qty: float = 10,
    active_stores: DataFrame | None = None,
) -> DataFrame:
    """The k best items by revenue, margin or quantity.

    By margin and by quantity only sold rows (quantity > 0) count, and by margin
    an item needs more than min_qty units. An item without a known cost has no
    margin and ranks last.
    """
    facts = selected(g, as_of, days, period, active_stores)
    if by != "revenue":
        facts = facts.filter(SOLD)
    made = {"qtd_vendida": "sum(total_quantity)", "receita_total": "sum(total_net)"}
    if by == "revenue":
        made["preco_total"] = "sum(total_price)"
        made["custo_medio"] = m.rounded(MEAN_COST)
    if by == "quantity":
        made["preco_medio"] = m.rounded(m.average(m.unit_price("net")))
        made["lojas_que_venderam"] = "count(DISTINCT store_id)"
    else:
        made["margem_total"] = f"round({MARGIN_SUM}, 2)"
        made["margem_pct"] = m.percent(MARGIN_SUM, "sum(total_net)")
    sums = facts.groupBy("item_id").agg(*columns(**made))
    if by == "margin":
        sums = sums.filter(f"qtd_vendida > {min_qty}")
    best = labelled(sums, i).orderBy(F.desc_nulls_last(RANKED_BY[by]), "item_id").limit(k)
    return best.select("artigo", "codigo", *made)


def product_summary(
    g: DataFrame, i: DataFrame, as_of: AsOf = None, days: int = 30, period: w.Window | None = None, k: int = 10
) -> DataFrame:
    """The k items with most revenue: quantity, revenue, margin."""
    sums = (
        selected(g, as_of, days, period)
        .groupBy("item_id")
        .agg(
            *columns(
                qtd_vendida="sum(total_quantity)", receita="sum(total_net)", margem=f"round({MARGIN_SUM}, 2)"
            )
        )
    )
    best = labelled(sums, i).orderBy(F.desc_nulls_last("receita"), "item_id").limit(k)
    return best.selectExpr("artigo AS produto", "codigo", "qtd_vendida", "receita", "margem")


def slow_items(g: DataFrame, i: DataFrame, as_of: AsOf = None, days: int = 30, k: int = 20) -> DataFrame:
    """The k items that sold the fewest units, among those that sold."""
    sums = (
        selected(g, as_of, days)
        .filter(SOLD)
        .groupBy("item_id")
        .agg(*columns(qtd_vendida="sum(total_quantity)", receita="sum(total_net)", ultima_venda="max(date)"))
    )
    slow = labelled(sums, i).orderBy("qtd_vendida", "item_id").limit(k)
    return slow.select("artigo", "codigo", "qtd_vendida", "receita", "ultima_venda")


def loss_items(
    g: DataFrame,
    i: DataFrame,
    as_of: AsOf = None,
    days: int = 30,
    price_basis: str = "gross",
    period: w.Window | None = None,
) -> DataFrame:
    """Items whose mean unit cost exceeds their mean selling price, worst first.

    Means are over store-days and unweighted, the loss is a sum; an item may
    pass the test and still show a positive total.
    """
    sums = (
        selected(g, as_of, days, period)
        .filter(f"{SOLD} AND latest_price_cost > 0")
        .groupBy("item_id")
        .agg(
            *columns(
                ocorrencias="count(*)",
                qtd_vendida="sum(total_quantity)",
                custo=MEAN_COST,
                preco=m.average(m.unit_price(price_basis)),
                prejuizo_total=f"round({MARGIN_SUM}, 2)",
            )
        )
    )
    return (
        labelled(sums.filter("custo > preco"), i)
        .orderBy("prejuizo_total", "item_id")
        .selectExpr(
            "artigo",
            "codigo",
            "ocorrencias",
            "qtd_vendida",
            f"{m.rounded('custo', 4)} AS custo_medio",
            f"{m.rounded('preco', 4)} AS preco_venda_medio",
            f"{m.rounded('preco - custo', 4)} AS margem_unitaria",
            "prejuizo_total",
        )
    )


def unprofitable_items(
    g: DataFrame, i: DataFrame, as_of: AsOf = None, days: int = 30, price_basis: str = "net"
) -> DataFrame:
    """The same test without a cost filter, largest quantity first."""
    sums = (
        selected(g, as_of, days)
        .filter(SOLD)
        .groupBy("item_id")
        .agg(
            *columns(custo=MEAN_COST, preco=m.average(m.unit_price(price_basis)), qtd_vendida="sum(total_quantity)")
        )
    )
    return (
        labelled(sums.filter("custo > preco"), i)
        .orderBy(F.desc("qtd_vendida"), "item_id")
        .selectExpr(
            "artigo",
            "codigo",
            f"{m.rounded('custo')} AS custo_medio",
            f"{m.rounded('preco')} AS preco_venda_medio",
            "qtd_vendida",
        )
    )


def low_margin_items(
    g: DataFrame, i: DataFrame, as_of: AsOf = None, days: int = 30, below: float = 0.1
) -> DataFrame:
    """Items whose margin is below a share of revenue, lowest first."""
    sums = (
        selected(g, as_of, days)
        .filter(SOLD)
        .groupBy("item_id")
        .agg(
            *columns(
                qtd_vendida="sum(total_quantity)", receita="sum(total_net)", custo=f"sum({m.COST})", margem=MARGIN_SUM
            )
        )
    )
    return (
        labelled(sums.filter(f"{m.ratio('margem', 'receita')} < {below}"), i)
        .withColumn("margem_pct", F.expr(m.percent("margem", "receita")))
        .orderBy("margem_pct", "item_id")
        .selectExpr(
            "artigo",
            "codigo",
            "qtd_vendida",
            "receita",
            "CAST(custo AS DECIMAL(28,5)) AS custo_total",
            "round(margem, 2) AS margem_total",
            "margem_pct",
        )
    )


def product_store_sales(
    g: DataFrame, i: DataFrame, s: DataFrame, period: w.Window, active_only: bool = True
) -> DataFrame:
    """Quantity, revenue and margin per item and store, with both names."""
    sums = (
        selected(g, period=period)
        .groupBy("item_id", "store_id")
        .agg(
            *columns(
                qtd_vendida="sum(total_quantity)", receita="sum(total_net)", margem=f"round({MARGIN_SUM}, 2)"
            )
        )
    )
    if active_only:
        s = s.filter("status = 1")
    names = s.selectExpr("id AS store_id", "name AS loja")
    return (
        labelled(sums, i)
        .join(names, "store_id")
        .select("artigo", "codigo", "loja", "qtd_vendida", "receita", "margem")
    )


def margin_by_category(g: DataFrame, i: DataFrame, period: w.Window) -> DataFrame:
    """Revenue and margin per item family and group."""
    sums = selected(g, period=period).groupBy("item_id").agg(*columns(net="sum(total_net)", margin=MARGIN_SUM))
    return (
        sums.join(i.selectExpr("id AS item_id", "family_id", "group_id"), "item_id")
        .groupBy("family_id", "group_id")
        .agg(
            *columns(
                artigos="count(*)",
                receita="sum(net)",
                margem="round(sum(margin), 2)",
                margem_pct=m.percent("sum(margin)", "sum(net)"),
            )
        )
        .orderBy("family_id", "group_id")
    )


def margin_cube(
    g: DataFrame,
    i: DataFrame,
    s: DataFrame,
    period: w.Window,
    store_ids: list[int] | None = None,
    item_ids: list[int] | None = None,
    families: list[int] | None = None,
) -> DataFrame:
    """Revenue, margin and distinct store-days per item family, per family and store, per
    family and month, per store, per month, and over all: one result from one pass.

    nivel is the grouping id of (family_id, store_id, mes), 7 for the total; a column that
    a row adds up over is NULL. The lists, where given, choose stores, items and
    families. Facts are summed per family, store and day before they are repeated for each
    of the groupings, so these see no item rows and distinct store-days are exact.
    """
    for column, chosen in (("store_id", store_ids), ("item_id", item_ids)):
        g = g if chosen is None else g.filter(F.col(column).isin(chosen))
    of_family = i.selectExpr("id AS item_id", "family_id")
    of_family = of_family if families is None else of_family.filter(F.col("family_id").isin(families))
    daily = (
        selected(g, period=period)
        .join(of_family, "item_id")
        .groupBy("family_id", "store_id", "date")
        .agg(*columns(net="sum(total_net)", margin=MARGIN_SUM))
        .withColumn("mes", F.expr("CAST(trunc(date, 'month') AS DATE)"))
    )
    sets = [["family_id"], ["family_id", "store_id"], ["family_id", "mes"], ["store_id"], ["mes"], []]
    cube = daily.groupingSets(sets, "family_id", "store_id", "mes").agg(
        F.grouping_id().alias("nivel"),
        *columns(
            lojas_dia="count(DISTINCT store_id, date)",
            receita="sum(net)",
            margem="round(sum(margin), 2)",
            margem_pct=m.percent("sum(margin)", "sum(net)"),
        ),
    )
    names = s.selectExpr("id AS store_id", "name AS loja")
    return cube.join(names, "store_id", "left").select("nivel", "family_id", "loja", "mes", "lojas_dia", "receita", "margem", "margem_pct")


def totals_of_terms(g: DataFrame, terms: Iterable[str], period: w.Window) -> DataFrame:
    """Monthly totals of measures under the names the business has for them, one row per
    term and month; an unknown term is an error. A term that says the same as
    another one is reported as well."""
    sums = {term: f"sum({m.measure(term)})" for term in terms}
    monthly = selected(g, period=period).groupBy(F.expr("CAST(trunc(date, 'month') AS DATE)").alias("mes")).agg(*columns(**sums))
    rows = ", ".join(f"'{term}', CAST(`{term}` AS DECIMAL(38,5))" for term in sums)
    return monthly.selectExpr("mes", f"stack({len(sums)}, {rows}) AS (termo, total)").withColumn("total", F.expr("round(total, 2)"))


def stale_items(g: DataFrame, i: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Active items without a sale for more than `days` days, or never sold."""
    last = g.filter(f"{SOLD} AND date <= DATE'{as_of}'").groupBy("item_id").agg(*columns(ultima_venda="max(date)"))
    return (
        i.filter("status = 1")
        .selectExpr("id AS item_id", "description AS artigo", "pcode AS codigo")
        .join(last, "item_id", "left")
        .withColumn("dias_parado", F.expr(f"datediff(DATE'{as_of}', ultima_venda)"))
        .filter(f"dias_parado IS NULL OR dias_parado > {days}")
        .select("artigo", "codigo", "ultima_venda", "dias_parado")
    )
