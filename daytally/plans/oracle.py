"""DuckDB statements that give the same results as the catalogue entries.

They are written independently of the operators: plain joins first, then one
grouping, in the other engine's dialect. Counts come out as BIGINT and measures
as DOUBLE. Values are rounded as decimals, so that ties go away from zero.
"""

from __future__ import annotations

TABLES = """
stores AS (
  SELECT s_suppkey AS id, s_name AS name,
         concat('S', lpad(CAST(s_suppkey AS STRING), CAST(greatest(4, length(CAST(s_suppkey AS STRING))) AS INT), '0')) AS code,
         CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END AS status,
         n_name AS location, r_name AS sector
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
                LEFT JOIN region ON r_regionkey = n_regionkey
),
items AS (
  SELECT p_partkey AS id,
         concat('P', lpad(CAST(p_partkey AS STRING), CAST(greatest(8, length(CAST(p_partkey AS STRING))) AS INT), '0')) AS pcode,
         concat(p_name, ' ', CAST(p_partkey AS STRING)) AS description,
         CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS status,
         CAST(replace(p_brand, 'Brand#', '') AS INT) AS family_id,
         CAST(p_size AS INT) AS group_id
  FROM part
),
priced AS (
  SELECT l_orderkey, o_custkey, l_partkey AS item_id, l_suppkey AS store_id,
         CAST(l_shipdate AS DATE) AS date, l_returnflag,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS gross,
         CAST(l_discount AS DECIMAL(4,2)) AS disc,
         CAST(1 + CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(4,2)) AS factor,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2))
              * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2)) AS DECIMAL(15,4)) AS net
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
),
da_stores_date AS (
  SELECT store_id, date,
         COUNT(DISTINCT l_orderkey) AS nr_sales,
         COUNT(DISTINCT o_custkey) AS nr_persons,
         CAST(SUM(qty) AS DECIMAL(18,5)) AS total_quantity,
         CAST(SUM(net) AS DECIMAL(18,5)) AS total_net,
         CAST(SUM(net * factor) AS DECIMAL(18,5)) AS total_doc,
         COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS nr_credits,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN net ELSE 0 END) AS DECIMAL(18,5)) AS credits_total_net,
         CAST(SUM(gross * disc) AS DECIMAL(18,5)) AS total_discount
  FROM priced GROUP BY store_id, date
),
da_items_stores_date AS (
  SELECT item_id, store_id, date,
         CAST(SUM(qty) AS DECIMAL(18,5)) AS total_quantity,
         CAST(SUM(net) AS DECIMAL(18,5)) AS total_net,
         CAST(SUM(net * factor) AS DECIMAL(18,5)) AS total_price,
         CAST(MAX(p_retailprice) AS DECIMAL(18,5)) AS latest_price_cost,
         CAST(SUM(gross * disc) AS DECIMAL(18,5)) AS total_discount
  FROM priced LEFT JOIN part ON p_partkey = item_id
  GROUP BY item_id, store_id, date
),
f AS (SELECT d.*, s.name AS loja, s.status, s.location
      FROM da_stores_date d JOIN stores s ON s.id = d.store_id),
act AS (SELECT * FROM f WHERE status = 1),
g AS (SELECT d.*, i.description AS artigo, i.pcode AS codigo, i.family_id, i.group_id,
             CAST(d.total_quantity AS DECIMAL(20,5)) * d.latest_price_cost AS spent,
             d.total_net - CAST(d.total_quantity AS DECIMAL(20,5)) * d.latest_price_cost AS gain,
             CAST(CAST(d.total_net AS DOUBLE) / CAST(NULLIF(d.total_quantity, 0) AS DOUBLE) AS DECIMAL(20,10)) AS unit_net,
             CAST(CAST(d.total_price AS DOUBLE) / CAST(NULLIF(d.total_quantity, 0) AS DOUBLE) AS DECIMAL(20,10)) AS unit_gross
      FROM da_items_stores_date d JOIN items i ON i.id = d.item_id)
"""


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def rnd(x: str, places: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def div(a: str, b: str) -> str:
    return f"({dbl(a)} / {dbl(f'NULLIF({b}, 0)')})"


def pct(a: str, b: str) -> str:
    return rnd(f"{div(a, b)} * 100")


def total(c: str, alias: str) -> str:
    """A summed measure."""
    return f"{dbl(f'SUM({c})')} AS {alias}"


def count(c: str, alias: str) -> str:
    """A summed count."""
    return f"{big(f'SUM({c})')} AS {alias}"


MEAN_NET = rnd(div("SUM(total_net)", "COUNT(total_net)"))
TICKET = rnd(div("SUM(total_net)", "SUM(nr_sales)"))
LAST_30 = "date BETWEEN DATE '2001-05-31' AND DATE '2001-06-30'"
HISTORY = "date BETWEEN DATE '1998-06-30' AND DATE '2001-06-30'"


def _sales_on(rows: str) -> str:
    return f"""
      SELECT loja, date AS data, nr_sales AS num_vendas, nr_persons AS num_clientes,
             {dbl('total_quantity')} AS quantidade_total, {dbl('total_net')} AS vendas_sem_iva,
             {dbl('total_doc')} AS vendas_com_iva, {dbl('total_discount')} AS descontos
      FROM {rows} WHERE date = DATE '2001-06-30'"""


def _period_total(label: str, first: str, last: str) -> str:
    return f"""
      SELECT '{label}' AS periodo, COUNT(DISTINCT date) AS dias, {count('nr_sales', 'total_vendas')},
             {count('nr_persons', 'total_clientes')}, {total('total_quantity', 'quantidade_total')},
             {total('total_net', 'vendas_sem_iva')}, {total('total_doc', 'vendas_com_iva')},
             {MEAN_NET} AS media_diaria
      FROM act WHERE date BETWEEN DATE '{first}' AND DATE '{last}'"""


def _yoy_monthly(first: str, as_of: str, year: int, month: int) -> str:
    new, old = (f"COALESCE(SUM(total_net) FILTER (year(date) = {y}), 0)" for y in (year, year - 1))
    return f"""
      SELECT loja, month(date) AS mes, {dbl(new)} AS vendas_ano, {dbl(old)} AS vendas_ano_anterior,
             {dbl(f'ROUND({new} - {old}, 2)')} AS diferenca, {pct(f'({new} - {old})', old)} AS variacao_pct
      FROM act WHERE date BETWEEN DATE '{first}' AND DATE '{as_of}' AND month(date) <= {month}
      GROUP BY loja, mes"""


def _yoy(rows: str, where: str) -> str:
    new = "COALESCE(SUM(total_net) FILTER (date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'), 0)"
    old = "COALESCE(SUM(total_net) FILTER (year(date) = 2000), 0)"
    return f"""
      SELECT loja, {dbl(new)} AS vendas_este_ano, {dbl(old)} AS vendas_ano_passado,
             {pct(f'({new} - {old})', old)} AS variacao_percentual
      FROM {rows} WHERE {where} GROUP BY loja"""


def _top(order: str, columns: str, where: str, k: int = 20, having: str = "TRUE", rows: str = "g") -> str:
    return f"""
      SELECT artigo, codigo, {columns} FROM {rows} WHERE {where}
      GROUP BY item_id, artigo, codigo HAVING {having}
      ORDER BY {order} DESC NULLS LAST, item_id LIMIT {k}"""


QTY_NET = f"{total('total_quantity', 'qtd_vendida')}, {total('total_net', 'receita_total')}"
GAIN = f"{dbl('ROUND(SUM(gain), 2)')} AS margem_total, {pct('SUM(gain)', 'SUM(total_net)')} AS margem_pct"
BY_REVENUE = (
    f"{QTY_NET}, {total('total_price', 'preco_total')}, "
    f"{rnd(div('SUM(latest_price_cost)', 'COUNT(latest_price_cost)'))} AS custo_medio, {GAIN}"
)
MEAN_COST = div("SUM(latest_price_cost)", "COUNT(latest_price_cost)")


def _mean_price(basis: str) -> str:
    return div(f"SUM(unit_{basis})", f"COUNT(unit_{basis})")


def _loss(basis: str) -> str:
    price = _mean_price(basis)
    return f"""
      SELECT artigo, codigo, COUNT(*) AS ocorrencias, {total('total_quantity', 'qtd_vendida')},
             {rnd(MEAN_COST, 4)} AS custo_medio, {rnd(price, 4)} AS preco_venda_medio,
             {rnd(f'{price} - {MEAN_COST}', 4)} AS margem_unitaria, {dbl('ROUND(SUM(gain), 2)')} AS prejuizo_total
      FROM g WHERE {LAST_30} AND total_quantity > 0 AND latest_price_cost > 0
      GROUP BY item_id, artigo, codigo HAVING {MEAN_COST} > {price}"""


def _unprofitable(basis: str) -> str:
    price = _mean_price(basis)
    return f"""
      SELECT artigo, codigo, {rnd(MEAN_COST)} AS custo_medio, {rnd(price)} AS preco_venda_medio,
             {total('total_quantity', 'qtd_vendida')}
      FROM g WHERE {LAST_30} AND total_quantity > 0
      GROUP BY item_id, artigo, codigo HAVING {MEAN_COST} > {price}"""


SEASONAL = f"""
seasonal AS (
  SELECT item_id, artigo, codigo,
         SUM(CASE WHEN month(date) IN (6, 7, 8) THEN total_quantity ELSE 0 END) AS pico,
         SUM(CASE WHEN month(date) IN (12, 1, 2) THEN total_quantity ELSE 0 END) AS fora
  FROM g WHERE {HISTORY} AND total_quantity > 0
  GROUP BY item_id, artigo, codigo HAVING pico > 0 AND pico >= 2 * fora
)"""

SUMMER_SALES = """
summer AS (
  SELECT * FROM g WHERE date >= DATE '2000-06-01' AND date < DATE '2000-09-01' AND total_quantity > 0
)"""


def _together(targets: str, rows: str = "summer", k: int | None = 20) -> str:
    return f"""
      SELECT artigo AS description, COUNT(DISTINCT (store_id, date)) AS co_occurrence_days,
             {total('total_quantity', 'total_qty')}, {total('total_net', 'total_revenue')}
      FROM {rows}
      WHERE item_id NOT IN ({targets})
        AND (store_id, date) IN (SELECT (store_id, date) FROM {rows} WHERE item_id IN ({targets}))
      GROUP BY item_id, artigo {f"ORDER BY co_occurrence_days DESC, item_id LIMIT {k}" if k else ""}"""


# moveable feasts of the calendar years, as published
EASTER_SUNDAYS = (
    "1994-04-03", "1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12",
    "1999-04-04", "2000-04-23", "2001-04-15", "2002-03-31", "2003-04-20",
)

# fixed values: the holidays and retail periods of the calendar
_FIXED = [
    ("Ano Novo", None, "01-01", "01-01"),
    ("Dia da Liberdade", None, "04-25", "04-25"),
    ("Dia do Trabalhador", None, "05-01", "05-01"),
    ("Dia de Portugal", None, "06-10", "06-10"),
    ("Assunção de Nossa Senhora", None, "08-15", "08-15"),
    ("Implantação da República", None, "10-05", "10-05"),
    ("Dia de Todos os Santos", None, "11-01", "11-01"),
    ("Restauração da Independência", None, "12-01", "12-01"),
    ("Imaculada Conceição", None, "12-08", "12-08"),
    ("Natal", None, "12-25", "12-25"),
    ("São João", "Porto, Braga", "06-23", "06-24"),
    ("São João (pico)", "Porto, Braga", "06-20", "06-25"),
    ("Romaria de São Bartolomeu", "Ponte de Lima", "08-19", "08-24"),
    ("Feira de São Mateus", "Viseu", "08-01", "09-30"),
    ("Regresso às aulas", None, "09-01", "09-15"),
    ("Semana da Black Friday", None, "11-25", "12-01"),
    ("Época de Natal", None, "12-01", "12-24"),
    ("Véspera e dia de Natal", None, "12-24", "12-25"),
]


def _calendar() -> str:
    rows = []
    for easter in EASTER_SUNDAYS:
        year = int(easter[:4])
        rows += [(e, c, f"{year}-{a}", f"{year}-{b}") for e, c, a, b in _FIXED]
        rows.append(("Passagem de ano", None, f"{year}-12-31", f"{year + 1}-01-01"))
    values = ", ".join(
        "({}, {}, DATE '{}', DATE '{}')".format(f"'{e}'", f"'{c}'" if c else "CAST(NULL AS VARCHAR)", a, b) for e, c, a, b in rows
    )
    sundays = ", ".join(f"(DATE '{d}')" for d in EASTER_SUNDAYS)
    return f"""
fixed_dates (event, city, first, last) AS (VALUES {values}),
sundays (sunday) AS (VALUES {sundays}),
november AS (
  SELECT MAX(d) AS friday FROM (SELECT CAST(unnest(generate_series(DATE '1994-11-01', DATE '2003-11-30', INTERVAL 1 DAY)) AS DATE) AS d)
  WHERE month(d) = 11 AND dayname(d) = 'Friday' GROUP BY year(d)
),
august AS (
  SELECT MIN(d) AS saturday FROM (SELECT CAST(unnest(generate_series(DATE '1994-08-01', DATE '2003-08-31', INTERVAL 1 DAY)) AS DATE) AS d)
  WHERE month(d) = 8 AND dayname(d) = 'Saturday' GROUP BY year(d)
),
cal AS (
  SELECT event, city, first, last FROM fixed_dates
  UNION ALL SELECT 'Carnaval', NULL, sunday - 47, sunday - 47 FROM sundays
  UNION ALL SELECT 'Sexta-feira Santa', NULL, sunday - 2, sunday - 2 FROM sundays
  UNION ALL SELECT 'Páscoa', NULL, sunday, sunday FROM sundays
  UNION ALL SELECT 'Semana da Páscoa', NULL, sunday - 2, sunday + 1 FROM sundays
  UNION ALL SELECT 'Corpo de Deus', NULL, sunday + 60, sunday + 60 FROM sundays
  UNION ALL SELECT 'Festas Gualterianas', 'Guimarães', saturday, saturday + 1 FROM august
  UNION ALL SELECT 'Black Friday', NULL, friday, friday FROM november
)"""


WINDOWS = {
    "today": ("2001-06-30", "2001-06-30"),
    "yesterday": ("2001-06-29", "2001-06-29"),
    "this_week": ("2001-06-25", "2001-06-30"),
    "this_month": ("2001-06-01", "2001-06-30"),
    "this_year": ("2001-01-01", "2001-06-30"),
    "last_month": ("2001-05-01", "2001-05-31"),
    "last_year": ("2000-01-01", "2000-12-31"),
}


def _window_totals() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS janela, COUNT(DISTINCT date) AS dias, {count('nr_sales', 'total_vendas')},
                   {total('total_net', 'receita_total')}
            FROM act WHERE date BETWEEN DATE '{lo}' AND DATE '{hi}' HAVING COUNT(*) > 0"""
        for name, (lo, hi) in WINDOWS.items()
    )


def _partitions(facts: str, pattern: str) -> str:
    return f"""
      SELECT CASE WHEN date < DATE '1996-01-01' THEN '{facts}_ppast'
                  WHEN date < DATE '2001-01-01' THEN '{facts}_p' || strftime(date, '{pattern}') END AS partition,
             COUNT(*) AS registos, MIN(date) AS primeira, MAX(date) AS ultima
      FROM {facts} GROUP BY partition"""


def _daily(where: str) -> str:
    return f"""
      SELECT date AS data, COUNT(*) AS lojas, {count('nr_sales', 'total_vendas')}, {total('total_net', 'receita_total')}
      FROM act WHERE {where} GROUP BY date"""


def _counts(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS tabela, COUNT(*) AS linhas, '{name}: ' || COUNT(*) AS texto FROM {rows}" for name, rows in tables.items()
    )


_FACT_COLUMNS = f"""store_id, date, nr_sales, nr_persons, {dbl('total_quantity')} AS total_quantity,
  {dbl('total_net')} AS total_net, {dbl('total_doc')} AS total_doc, nr_credits,
  {dbl('credits_total_net')} AS credits_total_net, {dbl('total_discount')} AS total_discount"""


def _mixed(keys: str, columns: str, kept: str) -> str:
    """Facts of which the narrow deliveries have the `kept` measures only."""
    narrow = "date >= DATE '2000-01-01' OR date = DATE '1999-06-01'"
    counts = ("nr_sales", "nr_persons", "nr_credits")
    values = {c: c if c in counts else dbl(c) for c in columns.split()}
    return ", ".join(
        [keys, *(f"{v} AS {c}" if c in kept.split() else f"CASE WHEN {narrow} THEN NULL ELSE {v} END AS {c}" for c, v in values.items())]
    )


MAY = "date BETWEEN DATE '2001-05-01' AND DATE '2001-05-31'"
LFL_A = "date BETWEEN DATE '2000-06-24' AND DATE '2000-06-26'"
LFL_B = "date BETWEEN DATE '2001-06-24' AND DATE '2001-06-26'"
COMPARABLE = f"""
both_periods AS (
  SELECT store_id FROM da_stores_date WHERE {LFL_A}
  INTERSECT SELECT store_id FROM da_stores_date WHERE {LFL_B}
)"""


def _lfl() -> str:
    a, b = (f"COALESCE(SUM(total_net) FILTER ({p}), 0)" for p in (LFL_A, LFL_B))
    return f"""
      SELECT loja AS name, {dbl(a)} AS revenue_a, {dbl(b)} AS revenue_b, {pct(f'({b} - {a})', a)} AS growth_pct
      FROM act WHERE store_id IN (SELECT store_id FROM both_periods) GROUP BY loja"""


def _seasons() -> str:
    summer = "COALESCE(SUM(total_net) FILTER (month(date) IN (6, 7, 8)), 0)"
    winter = "COALESCE(SUM(total_net) FILTER (month(date) IN (12, 1, 2)), 0)"
    return f"""
      SELECT loja, {dbl(summer)} AS verao, {dbl(winter)} AS inverno, {pct(f'({summer} - {winter})', winter)} AS variacao_pct
      FROM act WHERE {HISTORY} AND month(date) IN (6, 7, 8, 12, 1, 2) GROUP BY loja"""


FEAST_YEARS = """
feasts (sunday) AS (VALUES (DATE '1998-04-12'), (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15'), (DATE '2002-03-31'))"""


def _features() -> str:
    holidays = ", ".join(f"'{a}'" for e, _, a, b in _FIXED[:10])
    lags = ", ".join(
        f"(SELECT {dbl('p.total_net')} FROM d p WHERE p.store_id = d.store_id AND p.date = d.date - {n}) AS sales_lag_{n}"
        for n in (7, 30, 365)
    )
    means = ", ".join(
        f"""(SELECT {rnd(div('SUM(p.total_net)', 'COUNT(p.total_net)'))} FROM d p
             WHERE p.store_id = d.store_id AND p.date BETWEEN d.date - {n - 1} AND d.date) AS rolling_mean_{n}"""
        for n in (7, 30)
    )
    return f"""
      SELECT store_id, date, {dbl('total_net')} AS total_net, dayofweek(date) AS day_of_week, month(date) AS month,
             quarter(date) AS quarter, {big("dayname(date) IN ('Saturday', 'Sunday')")} AS is_weekend,
             {big(f"strftime(date, '%m-%d') IN ({holidays}) OR EXISTS (SELECT 1 FROM feasts WHERE date - sunday IN (-2, 0, 60))")}
               AS is_holiday,
             weekofyear(date) AS week_of_year,
             {big('(SELECT MIN(sunday) FROM feasts WHERE sunday >= date) - date')} AS days_to_easter,
             {big('make_date(year(date) + CASE WHEN month(date) = 12 AND day(date) > 25 THEN 1 ELSE 0 END, 12, 25) - date')}
               AS days_to_christmas,
             {lags}, {means}
      FROM d"""


def _forecast_ctes(first: str, end: str) -> str:
    """Monthly totals m (index 1 to 24), growth, misses and forecasts."""
    return f"""
monthly AS (
  SELECT store_id, CAST(date_diff('month', DATE '{first}', date) + 1 AS INT) AS i, SUM(total_net) AS net
  FROM da_stores_date WHERE date >= DATE '{first}' AND date < DATE '{end}' GROUP BY store_id, i
),
growing AS (
  SELECT store_id, {div('SUM(net) FILTER (i > 12)', 'SUM(net) FILTER (i <= 12)')} AS growth FROM monthly GROUP BY store_id
),
missed AS (
  SELECT n.store_id, quantile_cont({dbl('n.net')} - {dbl('o.net')} * growth, 0.1) AS low,
         quantile_cont({dbl('n.net')} - {dbl('o.net')} * growth, 0.9) AS high
  FROM monthly n JOIN monthly o ON o.store_id = n.store_id AND o.i = n.i - 12
                 JOIN growing w ON w.store_id = n.store_id GROUP BY n.store_id
),
ahead AS (
  SELECT m.store_id, CAST(DATE '{end}' + to_months(m.i - 13) AS DATE) AS mes, {dbl('m.net')} * growth AS base, low, high
  FROM monthly m JOIN growing USING (store_id) LEFT JOIN missed USING (store_id) WHERE m.i BETWEEN 13 AND 15
    AND growth IS NOT NULL
)"""


def _net_between(first: str, last: str) -> str:
    return f"COALESCE(SUM(total_net) FILTER (date BETWEEN DATE '{first}' AND DATE '{last}'), 0)"


def _kpi() -> str:
    mes, mes_ant = _net_between("2001-06-01", "2001-06-30"), _net_between("2001-05-01", "2001-05-31")
    ano, ano_ant = _net_between("2001-01-01", "2001-06-30"), _net_between("2000-01-01", "2000-06-30")
    return f"""
      SELECT {dbl(_net_between('2001-06-30', '2001-06-30'))} AS hoje, {dbl(mes)} AS mes, {dbl(ano)} AS ano,
             {dbl(mes_ant)} AS mes_anterior, {dbl(ano_ant)} AS ano_anterior,
             {pct(f'({mes} - {mes_ant})', mes_ant)} AS mom_pct, {pct(f'({ano} - {ano_ant})', ano_ant)} AS yoy_pct
      FROM act"""


def _margin_cube(where: str) -> str:
    return f"""
        SELECT CAST(c.nivel AS BIGINT) AS nivel, CAST(family_id AS BIGINT) AS family_id, s.name AS loja, mes, lojas_dia, receita, margem, margem_pct
        FROM (
          SELECT GROUPING(family_id, store_id, mes) AS nivel, family_id, store_id, mes,
                 COUNT(DISTINCT (store_id, date)) AS lojas_dia, {total('total_net', 'receita')}, {dbl('ROUND(SUM(gain), 2)')} AS margem,
                 {pct('SUM(gain)', 'SUM(total_net)')} AS margem_pct
          FROM (SELECT *, CAST(date_trunc('month', date) AS DATE) AS mes FROM g WHERE {where})
          GROUP BY GROUPING SETS ((family_id), (family_id, store_id), (family_id, mes), (store_id), (mes), ())) c
        LEFT JOIN stores s ON s.id = c.store_id"""


def _smoothed(first: str, last: str, months: int) -> str:
    """series and state: level, trend and seasons after each month, by recursion."""
    mean = "list_sum(list_slice(s, {}, {})) / 12"
    return f"""
spans AS (
  SELECT store_id, CAST(date_diff('month', DATE '{first}', date) AS INT) AS i, CAST(SUM(total_net) AS DOUBLE) AS net
  FROM da_stores_date WHERE date >= DATE '{first}' AND date < DATE '{last}' GROUP BY store_id, i),
series AS (
  SELECT g.store_id, list(COALESCE(net, 0) ORDER BY g.i) AS s
  FROM (SELECT store_id, CAST(unnest(range({months})) AS INT) AS i FROM (SELECT DISTINCT store_id FROM spans)) g
  LEFT JOIN spans p ON p.store_id = g.store_id AND p.i = g.i GROUP BY g.store_id),
state (store_id, i, level, trend, season) AS (
  SELECT store_id, 12, {mean.format(1, 12)}, ({mean.format(13, 24)} - {mean.format(1, 12)}) / 12,
         list_transform(list_slice(s, 1, 12), lambda y: y - {mean.format(1, 12)}) FROM series
  UNION ALL
  SELECT store_id, i + 1, l, 0.02::DOUBLE * (l - level) + 0.98::DOUBLE * trend,
         list_concat(list_slice(season, 2, 12), [0.2::DOUBLE * (y - l) + 0.8::DOUBLE * season[1]])
  FROM (SELECT t.*, x.s[i + 1] AS y, 0.2::DOUBLE * (x.s[i + 1] - season[1]) + 0.8::DOUBLE * (level + trend) AS l
        FROM state t JOIN series x ON x.store_id = t.store_id WHERE i < {months}))"""


RECURSIVE = ("seasonal_forecast", "rolling_errors")


def _extensions() -> dict[str, tuple[str, str]]:
    apr, may = _net_between("2001-04-01", "2001-04-30"), _net_between("2001-05-01", "2001-05-31")
    before, after = ("COALESCE(SUM(a.total_net) FILTER (a.date < e.day), 0)", "COALESCE(SUM(a.total_net) FILTER (a.date >= e.day), 0)")
    return {
        "day_features": (f"d AS (SELECT * FROM da_stores_date), {FEAST_YEARS}", _features() + f" WHERE {HISTORY}"),
        "monthly_forecast": (
            _forecast_ctes("1999-06-01", "2001-06-01"),
            f"SELECT store_id, mes, {rnd('base')} AS previsao, {rnd('base + low')} AS minimo, {rnd('base + high')} AS maximo FROM ahead",
        ),
        "seasonal_forecast": (
            _smoothed("1997-06-01", "2001-06-01", 48),
            f"""SELECT store_id, CAST(DATE '2001-06-01' + to_months(CAST(h - 1 AS INT)) AS DATE) AS mes,
                       {dbl('ROUND(CAST(level + h * trend + season[h] AS DECIMAL(28,10)), 2)')} AS previsao
                FROM state, (SELECT unnest(range(1, 4)) AS h) WHERE i = 48""",
        ),
        "rolling_errors": (
            _smoothed("1996-06-01", "2001-06-01", 60)
            + """,
scored AS (
  SELECT t.i, h, x.s[t.i + h] AS net, level + h * trend + season[h] AS previsao
  FROM state t JOIN series x ON x.store_id = t.store_id, (SELECT unnest(range(1, 4)) AS h) WHERE t.i BETWEEN 46 AND 57)""",
            f"""SELECT CAST(DATE '1996-06-01' + to_months(CAST(i AS INT)) AS DATE) AS origem, h AS horizonte, COUNT(*) AS lojas,
                       {dbl('ROUND(CAST(CAST(SUM(CAST(abs(net - previsao) / net AS DECIMAL(20,10))) AS DOUBLE) / COUNT(*) * 100 AS DECIMAL(28,10)), 2)')} AS mape_pct
                FROM scored WHERE net > 0 GROUP BY i, h""",
        ),
        "forecast_error": (
            _forecast_ctes("1999-03-01", "2001-03-01")
            + """,
actual AS (
  SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS mes, SUM(total_net) AS real
  FROM da_stores_date WHERE date >= DATE '2001-03-01' AND date < DATE '2001-06-01' GROUP BY 1, 2
),
compared AS (
  SELECT CAST(ABS(CAST(real AS DOUBLE) - ROUND(CAST(base AS DECIMAL(28,10)), 2)) / CAST(real AS DOUBLE) AS DECIMAL(20,10)) AS miss
  FROM ahead JOIN actual USING (store_id, mes)
)""",
            f"SELECT COUNT(*) AS meses, {rnd('CAST(SUM(miss) AS DOUBLE) / NULLIF(COUNT(miss), 0) * 100')} AS mape_pct FROM compared",
        ),
        "trend_alerts": (
            f"""both_months AS (
              SELECT loja, {apr} AS a, {may} AS b FROM act
              WHERE date BETWEEN DATE '2001-04-01' AND DATE '2001-05-31' GROUP BY store_id, loja)""",
            f"""SELECT loja, {dbl('a')} AS mes_anterior, {dbl('b')} AS ultimo_mes, {pct('(b - a)', 'a')} AS variacao_pct
                FROM both_months WHERE {pct('(b - a)', 'a')} < -15""",
        ),
        "daily_anomalies": (
            f"""scored AS (
              SELECT x.loja, x.date, x.total_net, COUNT(*) AS n, {div('SUM(p.total_net)', 'COUNT(*)')} AS mean,
                     {div('SUM(CAST(p.total_net AS DECIMAL(20,5)) * p.total_net)', 'COUNT(*)')} AS square
              FROM act x JOIN act p ON p.store_id = x.store_id AND p.date BETWEEN x.date - 28 AND x.date - 1
              WHERE x.date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'
              GROUP BY x.store_id, x.loja, x.date, x.total_net HAVING COUNT(*) > 1),
            judged AS (
              SELECT *, CASE WHEN {dbl('total_net')} < mean * 0.7 THEN 'queda'
                             WHEN {dbl('total_net')} > mean + 3 * sqrt(greatest(square - mean * mean, 0)) THEN 'pico' END AS tipo
              FROM scored)""",
            f"""SELECT loja, date, {dbl('total_net')} AS total_net, {rnd('mean')} AS media_anterior, tipo
                FROM judged WHERE tipo IS NOT NULL""",
        ),
        "stale_items": (
            """last_sale AS (
              SELECT item_id, MAX(date) AS ultima FROM da_items_stores_date
              WHERE total_quantity > 0 AND date <= DATE '2001-06-30' GROUP BY item_id)""",
            f"""SELECT description AS artigo, pcode AS codigo, ultima AS ultima_venda, {big("DATE '2001-06-30' - ultima")} AS dias_parado
                FROM items LEFT JOIN last_sale ON item_id = id
                WHERE status = 1 AND (ultima IS NULL OR DATE '2001-06-30' - ultima > 90)""",
        ),
        "correlated_items": (
            """item_days AS (
              SELECT item_id, artigo, codigo, date, SUM(total_quantity) AS q FROM g
              WHERE date >= DATE '2000-06-01' AND date < DATE '2000-09-01' GROUP BY item_id, artigo, codigo, date),
            days AS (SELECT DISTINCT date FROM item_days),
            named_items AS (SELECT DISTINCT item_id, artigo, codigo FROM item_days WHERE item_id <> 7),
            vectors AS (
              SELECT n.item_id, n.artigo, n.codigo, COALESCE(CAST(v.q AS DOUBLE), 0) AS x, COALESCE(CAST(t.q AS DOUBLE), 0) AS y
              FROM named_items n CROSS JOIN days
              LEFT JOIN item_days v ON v.item_id = n.item_id AND v.date = days.date
              LEFT JOIN item_days t ON t.item_id = 7 AND t.date = days.date),
            scored AS (
              SELECT item_id, artigo, codigo, SUM(x) AS qtd_vendida,
                     ROUND(CAST((COUNT(*) * SUM(x * y) - SUM(x) * SUM(y))
                       / NULLIF(sqrt((COUNT(*) * SUM(x * x) - SUM(x) * SUM(x)) * (COUNT(*) * SUM(y * y) - SUM(y) * SUM(y))), 0)
                       AS DECIMAL(28,10)), 4) AS r
              FROM vectors GROUP BY item_id, artigo, codigo)""",
            f"""SELECT artigo, codigo, qtd_vendida, {dbl('r')} AS correlacao FROM scored
                ORDER BY r DESC NULLS LAST, item_id LIMIT 20""",
        ),
        "transfer_candidates": (
            """rates AS (
              SELECT item_id, artigo, codigo, store_id, s.name AS loja, SUM(total_quantity) AS qtd
              FROM g JOIN stores s ON s.id = store_id AND s.status = 1
              WHERE date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30' AND total_quantity > 0
              GROUP BY item_id, artigo, codigo, store_id, s.name),
            ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY qtd DESC, store_id) AS place FROM rates)""",
            f"""SELECT r.artigo, r.codigo, r.loja AS de_loja, {dbl('r.qtd')} AS qtd, b.loja AS para_loja, {dbl('b.qtd')} AS qtd_melhor
                FROM ranked r JOIN ranked b ON b.item_id = r.item_id AND b.place = 1
                WHERE {dbl('r.qtd')} <= 0.1 * {dbl('b.qtd')}""",
        ),
        "price_elasticity": (
            f"""logs AS (
              SELECT item_id, artigo, codigo, CAST(ln({div('total_net', 'total_quantity')}) AS DECIMAL(12,8)) AS p,
                     CAST(ln({dbl('total_quantity')}) AS DECIMAL(12,8)) AS q
              FROM g WHERE {HISTORY} AND total_quantity > 0 AND total_net > 0),
            sums AS (
              SELECT item_id, artigo, codigo, COUNT(*) AS dias, {dbl('SUM(p)')} AS sp, {dbl('SUM(q)')} AS sq,
                     {dbl('SUM(CAST(p AS DECIMAL(20,8)) * q)')} AS spq, {dbl('SUM(CAST(p AS DECIMAL(20,8)) * p)')} AS spp
              FROM logs GROUP BY item_id, artigo, codigo HAVING COUNT(*) >= 10)""",
            f"""SELECT artigo, codigo, dias,
                       {rnd('CASE WHEN dias * spp - sp * sp > 0.000001 THEN (dias * spq - sp * sq) / (dias * spp - sp * sp) END', 4)}
                         AS elasticidade FROM sums""",
        ),
        "kpi_strip": ("", _kpi()),
        "margin_cube": ("", _margin_cube("year(date) = 2000")),
        "margin_cube_of_some": (
            "",
            _margin_cube("year(date) = 2000 AND month(date) >= 10 AND store_id BETWEEN 1 AND 5 AND family_id IN (11, 12, 23)"),
        ),
        "totals_of_terms": (
            "of_year AS (SELECT CAST(date_trunc('month', date) AS DATE) AS mes, * FROM g WHERE year(date) = 2000)",
            " UNION ALL ".join(
                f"SELECT mes, '{term}' AS termo, {dbl(f'ROUND(SUM({value}), 2)')} AS total FROM of_year GROUP BY mes"
                for term, value in {
                    "vendas": "total_net",
                    "receita": "total_net",
                    "margem": "gain",
                    "quantidade": "total_quantity",
                    "desconto": "total_discount",
                }.items()
            ),
        ),
        "margin_by_category": (
            "",
            f"""SELECT {big('family_id')} AS family_id, {big('group_id')} AS group_id, COUNT(DISTINCT item_id) AS artigos,
                       {total('total_net', 'receita')}, {dbl('ROUND(SUM(gain), 2)')} AS margem,
                       {pct('SUM(gain)', 'SUM(total_net)')} AS margem_pct
                FROM g WHERE year(date) = 2001 AND month(date) = 6 GROUP BY ALL""",
        ),
        "weekday_month_profile": (
            "",
            f"""SELECT dayofweek(date) AS dia_num, month(date) AS mes, {total('total_net', 'receita_total')},
                       {MEAN_NET} AS receita_media
                FROM act WHERE year(date) = 2000 GROUP BY dia_num, mes""",
        ),
        "event_impact": (
            """records AS (
              SELECT store_id, loja AS event, location, date AS day,
                     ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY total_net DESC, date) AS place
              FROM f WHERE year(date) = 2000),
            e AS (SELECT event, location, day FROM records WHERE place = 1)""",
            f"""SELECT e.event, e.location, e.day, {dbl(before)} AS antes, {dbl(after)} AS depois,
                       {pct(f'({after} - {before})', before)} AS variacao_pct
                FROM e LEFT JOIN act a ON a.location = e.location AND a.date BETWEEN e.day - 14 AND e.day + 13
                GROUP BY e.event, e.location, e.day""",
        ),
        "best_weekday": (
            f"""means AS (
              SELECT loja, dayofweek(date) AS dia_num, {MEAN_NET} AS receita_media FROM act
              WHERE date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30' GROUP BY loja, dia_num)""",
            """SELECT loja, dia_num, receita_media FROM means
               QUALIFY ROW_NUMBER() OVER (PARTITION BY loja ORDER BY receita_media DESC, dia_num) = 1""",
        ),
    }


def _selects() -> dict[str, tuple[str, str]]:
    """Extra common table expressions and the final SELECT, per entry."""
    plain = {
        "sales_on_day": _sales_on("act"),
        "sales_on_day_any_status": _sales_on("f"),
        "store_day_totals": f"""
            SELECT loja, {total('total_net', 'vendas')}, {count('nr_sales', 'num_transacoes')}
            FROM act WHERE date = DATE '2001-06-30' GROUP BY loja""",
        "day_total": f"SELECT {total('total_net', 'vendas')} FROM da_stores_date WHERE date = DATE '2001-06-30'",
        "period_total_easter": _period_total("Páscoa 2001", "2001-04-13", "2001-04-15"),
        "period_total_christmas": _period_total("Natal 2000", "2000-12-24", "2000-12-25"),
        "period_by_store": f"""
            SELECT loja, {total('total_net', 'vendas')}, {count('nr_sales', 'num_vendas')}, {TICKET} AS ticket_medio
            FROM act WHERE date BETWEEN DATE '2001-04-13' AND DATE '2001-04-15' GROUP BY loja""",
        "period_by_store_with_customers": f"""
            SELECT loja, {total('total_net', 'vendas')}, {count('nr_sales', 'num_vendas')},
                   {count('nr_persons', 'num_clientes')}, {TICKET} AS ticket_medio
            FROM act WHERE date BETWEEN DATE '2001-04-13' AND DATE '2001-04-15' GROUP BY loja""",
        "store_history": f"""
            SELECT loja, date AS data, nr_sales AS vendas, nr_persons AS clientes,
                   {dbl('total_net')} AS receita, {dbl('total_discount')} AS descontos
            FROM f WHERE loja = 'Supplier#000000001' AND {LAST_30}""",
        "ytd_by_store": f"""
            SELECT loja, COUNT(*) AS dias_operacao, {count('nr_sales', 'total_vendas')},
                   {count('nr_persons', 'total_clientes')}, {total('total_net', 'receita_total')},
                   {MEAN_NET} AS media_diaria, {TICKET} AS ticket_medio
            FROM act WHERE year(date) = 2001 AND date <= DATE '2001-06-30' GROUP BY loja""",
        "annual_by_store": f"""
            SELECT loja, year(date) AS ano, {total('total_net', 'vendas_anuais')}, {count('nr_sales', 'num_vendas')},
                   {count('nr_persons', 'num_clientes')}, {MEAN_NET} AS media_diaria
            FROM act WHERE date BETWEEN DATE '1996-06-30' AND DATE '2001-06-30' GROUP BY loja, ano""",
        "store_ranking": f"""
            SELECT loja, COUNT(DISTINCT date) AS dias_operacao, {total('total_net', 'receita_total')},
                   {MEAN_NET} AS receita_media_dia, {count('nr_sales', 'total_vendas')}, {TICKET} AS ticket_medio,
                   {count('nr_persons', 'total_clientes')},
                   {rnd(div('SUM(nr_sales)', 'SUM(nr_persons)'))} AS vendas_por_cliente
            FROM act WHERE {LAST_30} GROUP BY loja""",
        "weekly_trend": f"""
            SELECT CAST(date_trunc('week', date) AS DATE) AS semana, COUNT(DISTINCT store_id) AS lojas_ativas,
                   {count('nr_sales', 'total_vendas')}, {count('nr_persons', 'total_clientes')},
                   {total('total_net', 'receita_total')}, {MEAN_NET} AS media_diaria
            FROM act WHERE date BETWEEN DATE '2001-04-07' AND DATE '2001-06-30' GROUP BY semana""",
        "weekday_profile": f"""
            SELECT dayname(date) AS dia_semana, dayofweek(date) AS dia_num, COUNT(*) AS ocorrencias,
                   {total('total_net', 'receita_total')}, {MEAN_NET} AS receita_media,
                   {count('nr_sales', 'total_vendas')}, {count('nr_persons', 'total_clientes')}
            FROM act WHERE date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30' GROUP BY dia_semana, dia_num""",
        "top_stores_last_month": f"""
            SELECT loja, {total('total_net', 'receita')} FROM act WHERE {MAY} GROUP BY loja
            ORDER BY SUM(total_net) DESC, loja LIMIT 5""",
        "stores_averaging_above": f"""
            SELECT loja, {MEAN_NET} AS media_diaria FROM act GROUP BY loja
            HAVING {div('SUM(total_net)', 'COUNT(total_net)')} > 56500""",
        "window_totals": _window_totals(),
        "daily_sales_30_days": _daily(LAST_30),
        "monthly_sales_of_year": f"""
            SELECT month(date) AS mes, {count('nr_sales', 'total_vendas')}, {total('total_net', 'receita_total')},
                   {TICKET} AS ticket_medio
            FROM act WHERE year(date) = 2000 GROUP BY mes""",
        "worst_days_last_month": _daily(MAY) + " ORDER BY SUM(total_net), date LIMIT 5",
        "season_comparison": _seasons(),
        "yoy_monthly": _yoy_monthly("1999-06-30", "2001-06-30", 2001, 6),
        "yoy_monthly_leap_day": _yoy_monthly("1998-02-28", "2000-02-29", 2000, 2),
        "yoy_by_store": _yoy("act", "TRUE"),
        "yoy_by_store_recent": _yoy("f", "date BETWEEN DATE '1999-06-30' AND DATE '2001-06-30'"),
        "top_items_by_revenue": _top("SUM(total_net)", BY_REVENUE, LAST_30),
        "top_items_by_revenue_newest": _top(
            "SUM(total_net)", BY_REVENUE, "date >= (SELECT MAX(date) - 30 FROM da_items_stores_date)"
        ),
        "top_items_by_margin": _top(
            "SUM(gain)", f"{QTY_NET}, {GAIN}", f"{LAST_30} AND total_quantity > 0", having="SUM(total_quantity) > 10"
        ),
        "top_items_by_quantity": _top(
            "SUM(total_quantity)",
            f"{QTY_NET}, {rnd(_mean_price('net'))} AS preco_medio, COUNT(DISTINCT store_id) AS lojas_que_venderam",
            f"{LAST_30} AND total_quantity > 0",
        ),
        "top_items_active_stores": _top(
            "SUM(total_net)", BY_REVENUE, f"{LAST_30} AND store_id IN (SELECT id FROM stores WHERE status = 1)"
        ),
        "top_items_of_month": _top("SUM(total_net)", BY_REVENUE, "year(date) = 2000 AND month(date) = 11", k=10),
        "best_margin_of_quarter": _top(
            "SUM(gain)",
            f"{QTY_NET}, {GAIN}",
            "year(date) = 2000 AND month(date) >= 10 AND total_quantity > 0",
            having="SUM(total_quantity) > 10",
        ),
        "product_summary": f"""
            SELECT artigo AS produto, codigo, {total('total_quantity', 'qtd_vendida')}, {total('total_net', 'receita')},
                   {dbl('ROUND(SUM(gain), 2)')} AS margem
            FROM g WHERE {LAST_30} GROUP BY item_id, artigo, codigo ORDER BY SUM(total_net) DESC, item_id LIMIT 10""",
        "slow_items": f"""
            SELECT artigo, codigo, {total('total_quantity', 'qtd_vendida')}, {total('total_net', 'receita')},
                   MAX(date) AS ultima_venda
            FROM g WHERE {LAST_30} AND total_quantity > 0 GROUP BY item_id, artigo, codigo
            ORDER BY SUM(total_quantity), item_id LIMIT 20""",
        "loss_items": _loss("gross"),
        "loss_items_net": _loss("net"),
        "unprofitable_items": _unprofitable("net"),
        "unprofitable_items_gross": _unprofitable("gross"),
        "low_margin_items": f"""
            SELECT artigo, codigo, {total('total_quantity', 'qtd_vendida')}, {total('total_net', 'receita')},
                   {dbl('CAST(SUM(spent) AS DECIMAL(28,5))')} AS custo_total, {GAIN}
            FROM g WHERE {LAST_30} AND total_quantity > 0 GROUP BY item_id, artigo, codigo
            HAVING {div('SUM(gain)', 'SUM(total_net)')} < 0.1""",
        "product_store_sales": f"""
            SELECT artigo, codigo, name AS loja, {total('total_quantity', 'qtd_vendida')}, {total('total_net', 'receita')},
                   {dbl('ROUND(SUM(gain), 2)')} AS margem
            FROM g JOIN stores s ON s.id = g.store_id
            WHERE s.status = 1 AND year(date) = 2001 AND month(date) = 6
            GROUP BY item_id, artigo, codigo, s.id, name""",
        "facts_per_store_day": f"SELECT {_FACT_COLUMNS} FROM da_stores_date",
        "facts_per_item_day": f"""
            SELECT item_id, store_id, date, {dbl('total_quantity')} AS total_quantity, {dbl('total_net')} AS total_net,
                   {dbl('total_price')} AS total_price, {dbl('latest_price_cost')} AS latest_price_cost,
                   {dbl('total_discount')} AS total_discount
            FROM da_items_stores_date""",
        "load_and_count": _counts(
            {
                "stores": "stores",
                "items": "items",
                "da_stores_date": "da_stores_date",
                "da_items_stores_date": "da_items_stores_date",
            }
        ),
        "load_increment_and_count": _counts({t: t for t in ("stores", "items", "da_stores_date", "da_items_stores_date")}),
        "load_rejects_counted": _counts(
            {
                "stores": "stores",
                "items": "items",
                "da_stores_date": "(SELECT * FROM da_stores_date WHERE date < DATE '2001-01-01')",
                "da_items_stores_date": "(SELECT * FROM da_items_stores_date WHERE date < DATE '2001-01-01')",
                "rejected_da_stores_date": "(SELECT * FROM da_stores_date WHERE date >= DATE '2001-01-01')",
                "rejected_da_items_stores_date": "(SELECT * FROM da_items_stores_date WHERE date >= DATE '2001-01-01')",
            }
        ),
        "landed_item_days": f"""
            SELECT item_id, store_id, date, {dbl('total_quantity')} AS total_quantity, {dbl('total_net')} AS total_net,
                   {dbl('total_price')} AS total_price, {dbl('latest_price_cost')} AS latest_price_cost,
                   {dbl('total_discount')} AS total_discount
            FROM da_items_stores_date""",
        "merged_store_days": f"SELECT {_FACT_COLUMNS} FROM da_stores_date",
        "mixed_store_days": "SELECT "
        + _mixed(
            "store_id, date",
            "nr_sales nr_persons total_quantity total_net total_doc nr_credits credits_total_net total_discount",
            "nr_sales nr_persons total_net",
        )
        + " FROM da_stores_date",
        "mixed_item_days": "SELECT "
        + _mixed(
            "item_id, store_id, date",
            "total_quantity total_net total_price latest_price_cost total_discount",
            "total_quantity total_net latest_price_cost",
        )
        + " FROM da_items_stores_date",
        "late_lines_store_days": f"SELECT {_FACT_COLUMNS} FROM da_stores_date",
        "late_lines_item_days": f"""
            SELECT item_id, store_id, date, {dbl('total_quantity')} AS total_quantity, {dbl('total_net')} AS total_net,
                   {dbl('total_price')} AS total_price, {dbl('latest_price_cost')} AS latest_price_cost,
                   {dbl('total_discount')} AS total_discount
            FROM da_items_stores_date""",
        "key_counts": """
            SELECT 'da_stores_date' AS tabela, COUNT(*) AS linhas, COUNT(DISTINCT (store_id, date)) AS chaves FROM da_stores_date
            UNION ALL
            SELECT 'da_items_stores_date', COUNT(*), COUNT(DISTINCT (item_id, store_id, date)) FROM da_items_stores_date""",
        "missing_days_of_one_location": """
            SELECT d AS date FROM (
              SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS d
              FROM f WHERE location = 'PERU')
            WHERE d NOT IN (SELECT date FROM f WHERE location = 'PERU')""",
        "load_delta": f"""
            SELECT {big("SUM(CASE WHEN date < DATE '2000-01-01' THEN 1 ELSE 0 END)")} AS linhas_antes, COUNT(*) AS linhas_depois,
                   {big("SUM(CASE WHEN date >= DATE '2000-01-01' THEN 1 ELSE 0 END)")} AS importadas,
                   MIN(date) AS primeira, MAX(date) AS ultima
            FROM da_items_stores_date""",
        "load_progress": """
            SELECT COUNT(*) AS linhas, MIN(date) AS primeira, MAX(date) AS ultima,
                   CAST(COUNT(*) * 100 // 2500000 AS BIGINT) AS percent
            FROM da_items_stores_date""",
        "store_partitions": _partitions("da_stores_date", "%Y"),
        "item_partitions": _partitions("da_items_stores_date", "%Y%m"),
        "rejected_facts": f"""
            SELECT item_id, store_id, date, {dbl('total_quantity')} AS total_quantity, {dbl('total_net')} AS total_net
            FROM da_items_stores_date WHERE date >= DATE '2001-01-01'""",
        "duplicate_line_keys": """
            SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS linhas FROM lineitem
            GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
        "row_counts": _counts({t: t for t in ("stores", "items", "da_stores_date", "da_items_stores_date")}),
        "coverage": """
            SELECT year(date) AS ano, month(date) AS mes, COUNT(*) AS registos
            FROM da_items_stores_date GROUP BY ano, mes""",
        "missing_days": """
            SELECT d AS date FROM (
              SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS d FROM da_items_stores_date)
            WHERE d NOT IN (SELECT date FROM da_items_stores_date)""",
        "missing_days_of_one_item": """
            SELECT d AS date FROM (
              SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS d
              FROM da_items_stores_date WHERE item_id = 7)
            WHERE d NOT IN (SELECT date FROM da_items_stores_date WHERE item_id = 7)""",
        "missing_days_of_one_store": """
            SELECT d AS date FROM (
              SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS d
              FROM f WHERE loja = 'Supplier#000000001')
            WHERE d NOT IN (SELECT date FROM f WHERE loja = 'Supplier#000000001')""",
        "missing_ranges_by_store": """
            SELECT store_id, date + 1 AS de, following - 1 AS ate, CAST(following - date - 1 AS BIGINT) AS dias
            FROM (SELECT store_id, date, LEAD(date) OVER (PARTITION BY store_id ORDER BY date) AS following FROM da_stores_date)
            WHERE following - date > 1""",
        "data_context": """
            SELECT MIN(date) AS data_inicial, MAX(date) AS data_final,
                   (SELECT COUNT(*) FROM stores WHERE status = 1) AS lojas_ativas,
                   (SELECT COUNT(*) FROM items WHERE status = 1) AS artigos_ativos
            FROM da_stores_date""",
        "active_stores": "SELECT id, name FROM stores WHERE status = 1",
        "store_list": "SELECT id, name, code FROM stores",
        "newest_facts": f"SELECT {_FACT_COLUMNS} FROM da_stores_date d ORDER BY d.date DESC, d.store_id LIMIT 10",
        "sample_stores": f"SELECT id, name, code, {big('status')} AS status, location, sector FROM stores ORDER BY id LIMIT 5",
        "capped_result": f"""
            SELECT store_id, date, nr_sales, {dbl('total_net')} AS total_net, COUNT(*) OVER () AS total_rows,
                   CASE WHEN COUNT(*) OVER () > 200
                        THEN 'Showing first 200 of ' || COUNT(*) OVER () || ' rows.' END AS note
            FROM da_stores_date d WHERE {LAST_30} ORDER BY d.store_id, d.date LIMIT 200""",
        "plain_values": "SELECT "
        + ", ".join(
            f"{dbl(c)} AS {c}"
            for c in (
                "store_id nr_sales nr_persons total_quantity total_net total_doc nr_credits credits_total_net total_discount"
            ).split()
        )
        + f", strftime(d.date, '%Y-%m-%d') AS date FROM da_stores_date d WHERE {LAST_30}",
    }
    together = {
        "like_for_like": (COMPARABLE, _lfl()),
        "comparable_stores": (COMPARABLE, "SELECT store_id FROM both_periods"),
        "co_occurring_many": (
            f"sales AS (SELECT * FROM g WHERE {HISTORY} AND total_quantity > 0)",
            _together(", ".join(map(str, range(1, 41))), "sales", None),
        ),
        "co_occurring": (f"sales AS (SELECT * FROM g WHERE {HISTORY} AND total_quantity > 0)", _together("7", "sales")),
        "seasonal_items": (
            SEASONAL,
            f"""SELECT item_id, artigo, codigo, {dbl('pico')} AS qtd_pico, {dbl('fora')} AS qtd_fora,
                       {div('pico', 'fora')} AS racio FROM seasonal""",
        ),
        "seasonal_bundles": (f"{SEASONAL}, {SUMMER_SALES}", _together("SELECT item_id FROM seasonal")),
        "bundles_per_seasonal_item": (
            f"{SEASONAL}, {SUMMER_SALES}",
            """SELECT t.artigo, p.artigo AS parceiro, COUNT(DISTINCT (p.store_id, p.date)) AS co_occurrence_days
               FROM summer t JOIN summer p ON p.store_id = t.store_id AND p.date = t.date AND p.item_id <> t.item_id
               WHERE t.item_id IN (SELECT item_id FROM seasonal)
               GROUP BY t.item_id, t.artigo, p.item_id, p.artigo""",
        ),
        "sales_in_retail_periods": (
            _calendar(),
            f"""SELECT event, city, first AS "start", last AS "end", COUNT(DISTINCT date) AS dias,
                       {count('nr_sales', 'total_vendas')}, {count('nr_persons', 'total_clientes')},
                       {total('total_quantity', 'quantidade_total')}, {total('total_net', 'vendas_sem_iva')},
                       {total('total_doc', 'vendas_com_iva')}, {MEAN_NET} AS media_diaria
                FROM act JOIN cal ON date BETWEEN first AND last GROUP BY event, city, first, last""",
        ),
    }
    together |= {
        "local_event_sales": (
            f"""{_calendar()},
            places (one_city, location) AS (VALUES ('Porto', 'BRAZIL'), ('Porto', 'PERU'), ('Braga', 'PERU'), ('Braga', 'FRANCE'),
              ('Guimarães', 'GERMANY'), ('Ponte de Lima', 'CANADA'), ('Viseu', 'CHINA'), ('Viseu', 'INDIA'), ('Viseu', 'JAPAN')),
            placed AS (
              SELECT DISTINCT event, first, last, location
              FROM (SELECT *, unnest(string_split(city, ', ')) AS one_city FROM cal WHERE city IS NOT NULL) JOIN places USING (one_city))""",
            f"""SELECT event, p.location, first AS "start", last AS "end", COUNT(DISTINCT date) AS dias, COUNT(*) AS lojas_dia,
                       {count('nr_sales', 'total_vendas')}, {total('total_net', 'vendas_sem_iva')}
                FROM act JOIN placed p ON p.location = act.location AND date BETWEEN first AND last
                GROUP BY event, p.location, first, last""",
        ),
        "correlation_matrix": (
            f"""sold AS (SELECT item_id, artigo, store_id, date, total_quantity AS q FROM g WHERE {HISTORY}),
            best AS (
              SELECT item_id, artigo, SUM(q) AS x, SUM(q * q) AS xx, row_number() OVER (ORDER BY SUM(q) DESC, item_id) AS no
              FROM sold GROUP BY item_id, artigo QUALIFY no <= 100),
            days AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM (SELECT DISTINCT store_id, date FROM sold)),
            met AS (
              SELECT a.item_id AS a, b.item_id AS b, SUM(a.q * b.q) AS xy FROM sold a JOIN sold b ON a.store_id = b.store_id AND a.date = b.date
              WHERE a.item_id IN (SELECT item_id FROM best) AND b.item_id IN (SELECT item_id FROM best) GROUP BY ALL),
            paired AS (
              SELECT a.artigo, b.artigo AS outro, n, CAST(a.x AS DOUBLE) AS x, CAST(a.xx AS DOUBLE) AS xx, CAST(b.x AS DOUBLE) AS y,
                     CAST(b.xx AS DOUBLE) AS yy, COALESCE(CAST(xy AS DOUBLE), 0) AS xy
              FROM best a JOIN best b ON a.no < b.no CROSS JOIN days LEFT JOIN met ON met.a = a.item_id AND met.b = b.item_id)""",
            f"""SELECT artigo, outro, {dbl('ROUND(CAST(r AS DECIMAL(28,10)), 4)')} AS correlacao FROM (
                  SELECT artigo, outro, CASE WHEN n * xx - x * x > 1e-9 * n * xx AND n * yy - y * y > 1e-9 * n * yy
                    THEN (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) END AS r FROM paired)""",
        ),
        "cross_sell": (
            f"""sold AS (
              SELECT DISTINCT store_id, date_trunc('month', date) AS mes, item_id, artigo FROM g WHERE {HISTORY} AND total_quantity > 0),
            support AS (SELECT item_id, artigo, COUNT(*) AS n FROM sold GROUP BY item_id, artigo),
            met AS (
              SELECT a.item_id AS a, b.item_id AS b, COUNT(*) AS n FROM sold a JOIN sold b
                ON a.store_id = b.store_id AND a.mes = b.mes AND a.item_id < b.item_id GROUP BY ALL HAVING COUNT(*) >= 2),
            every AS (SELECT COUNT(*) AS total FROM (SELECT DISTINCT store_id, mes FROM sold))""",
            f"""SELECT x.artigo, y.artigo AS outro, met.n AS cestos, {dbl('ROUND(CAST(met.n * 100 / x.n AS DECIMAL(28,10)), 2)')} AS confianca_pct,
                       {dbl('ROUND(CAST(met.n * 100 / y.n AS DECIMAL(28,10)), 2)')} AS confianca_inversa_pct,
                       {dbl('ROUND(CAST(CAST(met.n AS DOUBLE) * total / (CAST(x.n AS DOUBLE) * CAST(y.n AS DOUBLE)) AS DECIMAL(28,10)), 4)')} AS lift
                FROM met JOIN support x ON x.item_id = met.a JOIN support y ON y.item_id = met.b CROSS JOIN every""",
        ),
    }
    return {name: ("", select) for name, select in plain.items()} | together | _extensions()


def statements() -> dict[str, str]:
    made = {}
    for name, (ctes, select) in _selects().items():
        extra = f",{ctes}" if ctes else ""
        made[name] = f"WITH {'RECURSIVE ' if name in RECURSIVE else ''}{TABLES.strip()}{extra}\n{select.strip()}"
    return made
