"""Metric definitions as SQL expressions over native functions.

Each function takes and returns SQL text, so that one definition serves row
level, aggregates (`ratio("sum(a)", "sum(b)")`) and windows alike. `columns`
turns named expressions into Columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

COST = "total_quantity * latest_price_cost"
# Revenue without VAT less units at their latest cost; NULL without a cost.
MARGIN = f"total_net - {COST}"


# The business vocabulary (fixed values): spoken term -> measure.
VOCABULARY = {
    "vendas": "total_net",
    "receita": "total_net",
    "margem": MARGIN,
    "quantidade": "total_quantity",
    "tiquets": "nr_sales",
    "transações": "nr_sales",
    "clientes": "nr_persons",
    "pessoas": "nr_persons",
    "custo": "latest_price_cost",
    "desconto": "total_discount",
}


def measure(term: str) -> str:
    """The measure behind a spoken term, whatever its case."""
    return VOCABULARY[term.strip().lower()]


def columns(**named: str) -> list[Column]:
    return [F.expr(f"{sql} AS {name}") for name, sql in named.items()]


def listed(values: Iterable[int]) -> str:
    """Whole numbers as the inside of an IN list."""
    return ", ".join(str(int(v)) for v in values)


def ratio(num: str, den: str) -> str:
    """num / den as a double; NULL where den is zero."""
    return f"(CAST({num} AS DOUBLE) / CAST(nullif({den}, 0) AS DOUBLE))"


def rounded(value: str, places: int = 2) -> str:
    """Round half away from zero in decimal arithmetic, so 1.005 gives 1.01."""
    return f"round(CAST({value} AS DECIMAL(28,10)), {places})"


def percent(part: str, whole: str) -> str:
    return rounded(f"{ratio(part, whole)} * 100")


def growth(new: str, old: str) -> str:
    """Change from old to new in percent; NULL where old is zero."""
    return percent(f"({new} - {old})", old)


def mean(total: str, n: str, places: int = 2) -> str:
    return rounded(ratio(total, n), places)


def average(value: str) -> str:
    """Unrounded mean over rows, from an exact sum."""
    return ratio(f"sum({value})", f"count({value})")


def ticket(net: str = "total_net", sales: str = "nr_sales") -> str:
    """Average ticket of already summed revenue and sale counts."""
    return mean(net, sales)


def unit_price(basis: str = "net") -> str:
    """Row-level selling price. Kept as a decimal so that its mean does not
    depend on the order in which tasks finish."""
    revenue = {"net": "total_net", "gross": "total_price"}[basis]
    return f"CAST({ratio(revenue, 'total_quantity')} AS DECIMAL(20,10))"


def sum_where(condition: str, measure: str = "total_net") -> str:
    """Sum of a measure where the condition holds, zero elsewhere."""
    return f"sum(CASE WHEN {condition} THEN {measure} ELSE CAST(0 AS DECIMAL(18,5)) END)"
