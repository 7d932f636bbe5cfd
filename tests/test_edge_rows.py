"""Hand-made rows for the cases real data rarely holds."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from helpers import d, item_days, items, rows, store_days, stores

from pyspark.sql import functions as F

from daytally.functions import windows as w
from daytally.functions.calendar import calendar
from daytally.operators import bundles, checks, compare, loading, periods, trends
from daytally.operators import items as it
from daytally.operators import stores as st
from daytally.schemas import LAYOUTS
from daytally.sources.transactions import sale_lines

AS_OF = date(2024, 6, 30)


def test_same_named_stores_are_added_up_and_days_stay_distinct(spark):
    s = stores(spark, (1, "Braga", 1), (2, "Braga", 1), (3, "Porto", 1))
    f = store_days(spark, (1, "2024-06-20", 100), (2, "2024-06-20", 50), (2, "2024-06-21", 30), (3, "2024-06-20", 10))
    ranking = {r.loja: r for r in st.store_ranking(f, s, AS_OF).collect()}
    assert ranking["Braga"].receita_total == 180 and ranking["Braga"].dias_operacao == 2
    assert ranking["Braga"].receita_media_dia == 60
    by_store = {r.loja: r for r in st.period_by_store(f, s, d("2024-06-20"), d("2024-06-21")).collect()}
    assert by_store["Braga"].vendas == 180 and by_store["Braga"].ticket_medio == 6
    weekly = st.weekly_trend(f, s, AS_OF).first()
    assert weekly.lojas_ativas == 3 and weekly.semana == date(2024, 6, 17)


def test_inactive_store_and_orphan_fact_are_left_out(spark):
    s = stores(spark, (1, "Braga", 1), (2, "Porto", 0))
    f = store_days(spark, (1, "2024-06-30", 100), (2, "2024-06-30", 70), (9, "2024-06-30", 999))
    assert rows(st.sales_on(f, s, AS_OF), "loja") == [("Braga",)]
    assert rows(st.sales_on(f, s, AS_OF, active_only=False), "loja") == [("Braga",), ("Porto",)]
    assert rows(st.store_history(f, s, "Porto", AS_OF), "receita") == [(70,)]
    # the day total reads facts alone
    assert st.day_total(f, AS_OF).first()[0] == 1169


def test_empty_period_gives_one_row(spark):
    s, f = stores(spark, (1, "Braga", 1)), store_days(spark, (1, "2024-06-30", 100))
    row = st.period_total(f, s, "nada", d("2020-01-01"), d("2020-01-02")).collect()
    assert len(row) == 1 and row[0].dias == 0 and row[0].vendas_sem_iva is None and row[0].media_diaria is None


def test_zero_sales_have_no_ticket(spark):
    s, f = stores(spark, (1, "Braga", 1)), store_days(spark, (1, "2024-06-30", 100, 0, 0))
    row = st.store_ranking(f, s, AS_OF).first()
    assert row.ticket_medio is None and row.vendas_por_cliente is None


def test_null_revenue_sorts_last_and_is_not_averaged(spark):
    s = stores(spark, (1, "Braga", 1), (2, "Porto", 1))
    f = store_days(spark, (1, "2024-06-30", None), (2, "2024-06-30", 5), (2, "2024-06-29", None))
    assert rows(st.sales_on(f, s, AS_OF), "loja") == [("Porto",), ("Braga",)]
    ytd = {r.loja: r for r in st.ytd_by_store(f, s, AS_OF).collect()}
    assert ytd["Porto"].dias_operacao == 2 and ytd["Porto"].media_diaria == 5


def test_items_without_cost_have_no_margin_and_rank_last(spark):
    g = item_days(
        spark,
        (1, 1, "2024-06-30", 20, 100, 3),
        (2, 1, "2024-06-30", 20, 500, None),
        (3, 1, "2024-06-30", 20, 90, 5),
    )
    best = rows(it.top_items(g, items(spark, 1, 2, 3), "margin", AS_OF), "codigo", "margem_total")
    assert best == [("P1", 40), ("P3", -10), ("P2", None)]


def test_returns_and_zero_quantities(spark):
    g = item_days(
        spark,
        (1, 1, "2024-06-30", 0, 10, 3),
        (1, 2, "2024-06-30", -5, -50, 3),
        (1, 3, "2024-06-30", 12, 0, 3),
        (2, 1, "2024-06-30", 10, 100, 1),
    )
    i = items(spark, 1, 2)
    revenue = {r.codigo: r for r in it.top_items(g, i, "revenue", AS_OF).collect()}
    assert revenue["P1"].qtd_vendida == 7 and revenue["P1"].receita_total == -40
    # sold rows only; revenue 0 leaves the margin percentage open
    margin = rows(it.top_items(g, i, "margin", AS_OF), "codigo", "margem_total", "margem_pct")
    assert margin == [("P1", -36, None)]  # item 2 sold 10, which is not more than 10
    assert rows(it.top_items(g, i, "quantity", AS_OF), "codigo", "preco_medio", "lojas_que_venderam") == [
        ("P1", 0, 1),
        ("P2", 10, 1),
    ]
    # no revenue, no ratio: not listed as low margin
    assert rows(it.low_margin_items(g, i, AS_OF), "codigo") == []


def test_loss_test_uses_unweighted_means(spark):
    g = item_days(
        spark,
        (1, 1, "2024-06-29", 1, 1, 5),
        (1, 2, "2024-06-29", 100, 700, 5),  # prices 1 and 7, mean 4 < 5, total margin positive
        (2, 1, "2024-06-29", 10, 40, 0),  # cost 0 is left out of the gross test
    )
    i = items(spark, 1, 2)
    net = it.loss_items(g, i, AS_OF, price_basis="net").collect()
    assert [(r.codigo, r.ocorrencias, r.margem_unitaria, r.prejuizo_total) for r in net] == [("P1", 2, -1, Decimal("196"))]
    assert rows(it.loss_items(g, i, AS_OF), "preco_venda_medio") == [(Decimal("4.8000"),)]
    assert rows(it.unprofitable_items(g, i, AS_OF), "codigo", "qtd_vendida") == [("P1", 101)]


def test_ties_are_broken_by_id(spark):
    g = item_days(spark, *[(n, 1, "2024-06-30", 20, 100, 1) for n in range(1, 30)])
    best = rows(it.top_items(g, items(spark, *range(1, 30)), "revenue", AS_OF), "codigo")
    assert best == [(f"P{n}",) for n in range(1, 21)]


def test_active_store_scope_of_items(spark):
    s = stores(spark, (1, "Braga", 1), (2, "Porto", 0))
    g = item_days(spark, (1, 1, "2024-06-30", 1, 10, 1), (1, 2, "2024-06-30", 1, 90, 1))
    i = items(spark, 1)
    assert it.top_items(g, i, "revenue", AS_OF).first().receita_total == 100
    assert it.top_items(g, i, "revenue", AS_OF, active_stores=s).first().receita_total == 10
    assert rows(it.product_store_sales(g, i, s, (d("2024-06-01"), d("2024-07-01"))), "loja") == [("Braga",)]


A, B = (d("2023-06-01"), d("2023-07-01")), (d("2024-06-01"), d("2024-07-01"))


def test_like_for_like_needs_both_periods(spark):
    s = stores(spark, (1, "Braga", 1), (2, "Porto", 1), (3, "Viseu", 1), (4, "Faro", 0))
    f = store_days(
        spark,
        (1, "2023-06-05", 100),
        (1, "2024-06-05", 150),
        (2, "2024-06-05", 70),
        (3, "2023-06-05", 70),
        (4, "2023-06-05", 1),
        (4, "2024-06-05", 1),
        (1, "2024-03-01", 5000),  # between the periods
    )
    assert rows(compare.compare(f, s, A, B, scope="lfl")) == [("Braga", 100, 150, 50)]
    everyone = rows(compare.compare(f, s, A, B), "name", "revenue_a", "revenue_b", "growth_pct")
    assert everyone == [("Braga", 100, 150, 50), ("Viseu", 70, 0, -100), ("Porto", 0, 70, None)]
    # like for like never holds more stores than either period
    both = {r.store_id for r in compare.comparable_stores(f, [A, B]).collect()}
    ids = [{r.store_id for r in f.filter(p).select("store_id").distinct().collect()} for p in
           ("date between '2023-06-01' and '2023-06-30'", "date between '2024-06-01' and '2024-06-30'")]
    assert both == ids[0] & ids[1] == {1, 4}


def test_like_for_like_merges_names_after_comparing_ids(spark):
    s = stores(spark, (1, "Braga", 1), (2, "Braga", 1))
    f = store_days(spark, (1, "2023-06-05", 100), (2, "2024-06-05", 70))
    assert rows(compare.compare(f, s, A, B, scope="lfl")) == []


def test_yoy_keeps_months_seen_only_earlier(spark):
    s = stores(spark, (1, "Braga", 1))
    f = store_days(spark, (1, "2022-06-30", 9), (1, "2023-05-01", 100), (1, "2024-05-01", 150), (1, "2023-07-01", 5))
    got = rows(compare.yoy_monthly(f, s, AS_OF), "mes", "vendas_ano", "vendas_ano_anterior", "diferenca", "variacao_pct")
    assert got == [(5, 150, 100, 50, 50), (6, 0, 0, 0, None)]


def test_co_occurrence(spark):
    g = item_days(
        spark,
        (1, 1, "2024-06-01", 1, 1, 1),
        (1, 1, "2024-06-02", -1, 1, 1),  # a return is no sale of the target
        (2, 1, "2024-06-01", 2, 20, 1),
        (2, 1, "2024-06-02", 2, 20, 1),
        (2, 2, "2024-06-01", 2, 20, 1),  # another store
        (3, 1, "2024-06-01", 0, 5, 1),
        (4, 1, "2024-05-01", 1, 5, 1),
        (1, 1, "2024-05-01", 1, 1, 1),  # outside the window
    )
    i = items(spark, 1, 2, 3, 4)
    window = (d("2024-06-01"), d("2024-07-01"))
    assert rows(bundles.co_occurring(g, i, [1], window)) == [("item 2", 1, 2, 20)]
    table = spark.createDataFrame([(1,), (1,)], "item_id bigint")
    assert rows(bundles.co_occurring(g, i, table, window)) == [("item 2", 1, 2, 20)]
    # a row repeated against the key does not count twice when asked to check
    twice = g.unionByName(g.filter("item_id = 2"))
    assert rows(bundles.co_occurring(twice, i, [1], window, unique_keys=False), "co_occurrence_days") == [(1,)]
    assert rows(bundles.bundles_per_target(g, i, table, window)) == [("item 1", "item 2", 1)]


def test_any_number_of_bundle_targets(spark):
    """More targets than bits, all sold together; the best partners per target on request."""
    n = 2 * bundles.BITS + 7
    g = item_days(spark, *[(item, 1, "2024-06-01", 1, 1, 1) for item in range(n)], *[(item, 2, "2024-06-01", 1, 1, 1) for item in (0, 5)])
    many, i = spark.range(n).withColumnRenamed("id", "item_id"), items(spark, *range(n))
    window = (d("2024-06-01"), d("2024-07-01"))
    got = bundles.bundles_per_target(g, i, many, window).collect()
    assert len(got) == n * (n - 1)
    assert {(r.artigo, r.parceiro) for r in got if r.co_occurrence_days == 2} == {("item 0", "item 5"), ("item 5", "item 0")}
    assert bundles.bundles_per_target(g, i, many, window, min_days=2).count() == 2
    best = bundles.bundles_per_target(g, i, many, window, k=1)
    assert best.count() == n and best.filter("artigo = 'item 5'").first().parceiro == "item 0"


def test_seasonal_item_without_off_season_sales_comes_first(spark):
    g = item_days(
        spark,
        (1, 1, "2024-07-01", 10, 1, 1),
        (1, 1, "2024-01-01", 5, 1, 1),
        (2, 1, "2024-07-01", 3, 1, 1),
        (3, 1, "2024-07-01", 9, 1, 1),
        (3, 1, "2024-01-01", 5, 1, 1),
    )
    got = rows(bundles.seasonal_items(g, items(spark, 1, 2, 3), (d("2024-01-01"), d("2025-01-01")), k=5), "item_id", "racio")
    assert got == [(2, None), (1, 2.0)]


def test_retail_periods_count_each_event_and_its_city(spark):
    s = stores(spark, (1, "A", 1, "Braga"), (2, "B", 1, "Viseu"), (3, "C", 0, "Porto"))
    f = store_days(spark, (1, "2024-06-23", 10), (1, "2024-06-24", 20), (2, "2024-06-24", 5), (3, "2024-06-24", 99), (2, "2024-08-31", 7))
    cal = calendar(spark, [2024])
    everywhere = {r.event: (r.dias, r.vendas_sem_iva, r.media_diaria) for r in periods.sales_in_periods(f, s, cal).collect()}
    assert everywhere == {
        "São João": (2, 35, Decimal("11.67")),
        "São João (pico)": (2, 35, Decimal("11.67")),
        "Feira de São Mateus": (1, 7, 7),
    }
    local = {(r.event, r.location): (r.dias, r.vendas_sem_iva) for r in periods.local_event_sales(f, s, cal).collect()}
    assert local == {
        ("São João", "Braga"): (2, 30),
        ("São João (pico)", "Braga"): (2, 30),
        ("Feira de São Mateus", "Viseu"): (1, 7),
    }


def test_partition_bounds(spark):
    layout = LAYOUTS["da_stores_date"]
    f = store_days(spark, (1, "2018-12-31", 1), (1, "2019-01-01", 1), (1, "2026-12-31", 1), (1, "2027-01-01", 1))
    sizes = dict(rows(loading.partition_sizes(f, layout), "partition", "registos"))
    assert sizes == {
        None: 1,
        "da_stores_date_ppast": 1,
        "da_stores_date_p2019": 1,
        "da_stores_date_p2026": 1,
    }
    routed = loading.route(f, layout)
    assert routed.accepted.count() == 3 and rows(routed.rejected, "date") == [(date(2027, 1, 1),)]
    monthly = item_days(spark, (1, 1, "2019-12-31", 1, 1, 1), (1, 1, "2020-01-01", 1, 1, 1), (1, 1, "2026-12-01", 1, 1, 1))
    names = {r[0] for r in rows(loading.partition_sizes(monthly, LAYOUTS["da_items_stores_date"]), "partition")}
    assert names == {"da_items_stores_date_ppast", "da_items_stores_date_p202001", "da_items_stores_date_p202612"}


def test_row_without_a_date_is_rejected(spark):
    f = spark.createDataFrame([(1, None)], "store_id bigint, date date")
    routed = loading.route(f, LAYOUTS["da_stores_date"])
    assert routed.accepted.count() == 0 and routed.rejected.count() == 1


def test_gaps(spark):
    f = store_days(spark, (1, "2024-06-01", 1), (1, "2024-06-05", 1), (2, "2024-06-02", 1), (2, "2024-06-03", 1))
    assert rows(checks.missing_days(f)) == [(date(2024, 6, 4),)]
    assert rows(checks.missing_ranges(f)) == [(1, date(2024, 6, 2), date(2024, 6, 4), 3)]
    assert rows(checks.missing_days(f.limit(0))) == []


def test_capped_result_says_what_it_left_out(spark):
    df = spark.range(7)
    got = checks.capped(df, ["id"], 5).collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4]
    assert {(r.total_rows, r.note) for r in got} == {(7, "Showing first 5 of 7 rows.")}
    assert {r.note for r in checks.capped(df, ["id"], 7).collect()} == {None}


def test_plain_values(spark):
    df = spark.sql("select date'2024-06-30' a, 1 b, 2.50bd c, 'x' d, timestamp'2024-06-30 10:20:30' e")
    assert rows(checks.plain_values(df)) == [("2024-06-30", 1.0, 2.5, "x", "2024-06-30T10:20:30")]


def test_stale_items_include_never_sold(spark):
    g = item_days(spark, (1, 1, "2024-03-31", 1, 1, 1), (2, 1, "2024-04-01", 1, 1, 1), (3, 1, "2024-07-15", 1, 1, 1))
    got = rows(it.stale_items(g, items(spark, 1, 2, 3), AS_OF), "codigo", "dias_parado")
    assert sorted(got, key=str) == [("P1", 91), ("P3", None)]


def test_lags_look_back_by_date(spark):
    f = store_days(spark, (1, "2024-06-01", 10), (1, "2024-06-02", 20), (1, "2024-06-08", 40), (1, "2024-06-10", 80))
    got = {r.date.day: r for r in trends.day_features(f).collect()}
    assert got[8].sales_lag_7 == 10 and got[10].sales_lag_7 is None  # 3 June has no fact
    assert got[8].rolling_mean_7 == 30  # 2 June and 8 June
    assert got[10].is_holiday == 1 and got[8].is_weekend == 1


def test_anomalies(spark):
    s = stores(spark, (1, "Braga", 1))
    quiet = [(1, f"2024-06-{n:02d}", 100 + n % 3) for n in range(1, 20)]
    f = store_days(spark, *quiet, (1, "2024-06-20", 60), (1, "2024-06-21", 900))
    got = rows(trends.daily_anomalies(f, s, (d("2024-06-15"), d("2024-07-01"))), "date", "tipo")
    assert sorted(got) == [(date(2024, 6, 20), "queda"), (date(2024, 6, 21), "pico")]


def test_finer_amounts_are_an_error(source):
    lines = source.table("lineitem").limit(5)
    assert sale_lines(lines).count() == 5
    for column, value in (("l_quantity", 0.125), ("l_discount", 0.075)):
        with pytest.raises(Exception, match="more than two decimals"):
            sale_lines(lines.withColumn(column, F.lit(value))).collect()
    row = sale_lines(lines.withColumn("l_discount", F.lit(None).cast("double"))).first()
    assert row.net is None and row.quantity is not None


def test_features_of_a_window_look_back_beyond_it(source):
    window = (date(2000, 3, 1), date(2000, 6, 1))
    whole = trends.day_features(source.store_days(None, ("total_net",))).filter(w.in_window(window))
    early = (window[0] - timedelta(days=trends.FEATURE_DAYS), window[1])
    part = trends.day_features(source.store_days(early, ("total_net",)), window)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.collect()))


def test_years_without_an_easter_rule_and_long_horizons_are_errors(spark):
    with pytest.raises(Exception, match="no Easter rule"):
        trends.day_features(store_days(spark, (1, "3001-01-01", 1))).collect()
    with pytest.raises(ValueError):
        trends.monthly_forecast(store_days(spark, (1, "2001-01-01", 1)), date(2001, 6, 1), horizon=18)
