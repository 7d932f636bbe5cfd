"""Products that sell on the same days in the same stores.

Facts are daily, so "sold together" means a sale in the same store on the same
day. No pair of items is ever formed: rows of partner items meet the set of
store-days on which a target sold, never the targets' own rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daytally.functions import measures as m
from daytally.functions import windows as w
from daytally.functions.measures import columns, listed
from daytally.operators.items import SOLD, labelled
from daytally.session import keep

STORE_DAY = ["store_id", "date"]
BITS = 60  # targets in a block, one bit each in a bigint


def _store_days_counted(unique_keys: bool) -> str:
    """Distinct store-days of an item. With unique keys an item has one row per
    store-day, and counting rows avoids shuffling every row for a distinct."""
    return "count(*)" if unique_keys else "count(DISTINCT struct(store_id, date))"


def co_occurring(
    g: DataFrame,
    i: DataFrame,
    targets: Iterable[int] | DataFrame,
    window: w.Window,
    k: int | None = 20,
    unique_keys: bool = True,
) -> DataFrame:
    """Items sold on store-days on which at least one target sold.

    targets is a short list of item ids, or a table with an item_id column of
    any size. Set unique_keys=False for facts whose key was not checked.
    """
    sales = w.clip(g, window).filter(SOLD)
    if isinstance(targets, DataFrame):
        ids = targets.select("item_id").distinct()
        hits = sales.join(ids, "item_id", "left_semi")
        partners = sales.join(ids, "item_id", "left_anti")
    else:
        among = F.col("item_id").isin(*targets)
        hits, partners = sales.filter(among), sales.filter(~among)
    target_days = hits.select(*STORE_DAY).distinct()
    sums = (
        partners.join(target_days, STORE_DAY, "left_semi")
        .groupBy("item_id")
        .agg(
            *columns(
                co_occurrence_days=_store_days_counted(unique_keys),
                total_qty="sum(total_quantity)",
                total_revenue="sum(total_net)",
            )
        )
    )
    ranked = labelled(sums, i)
    if k is not None:
        ranked = ranked.orderBy(F.desc("co_occurrence_days"), "item_id").limit(k)
    return ranked.selectExpr("artigo AS description", "co_occurrence_days", "total_qty", "total_revenue")


def seasonal_items(
    g: DataFrame,
    i: DataFrame,
    window: w.Window,
    peak: tuple[int, ...] = (6, 7, 8),
    off: tuple[int, ...] = (12, 1, 2),
    min_ratio: float = 2,
    k: int | None = None,
) -> DataFrame:
    """Items that sell at least min_ratio times as much in peak months as in
    off-season months, strongest first. An item that never sells off season has
    no ratio and comes before all others."""
    in_peak, off_season = (f"month(date) IN ({listed(months)})" for months in (peak, off))
    sums = (
        w.clip(g, window)
        .filter(SOLD)
        .filter(f"{in_peak} OR {off_season}")
        .groupBy("item_id")
        .agg(
            *columns(
                qtd_pico=m.sum_where(in_peak, "total_quantity"), qtd_fora=m.sum_where(off_season, "total_quantity")
            )
        )
    )
    strong = sums.filter(f"qtd_pico > 0 AND CAST(qtd_pico AS DOUBLE) >= {min_ratio} * CAST(qtd_fora AS DOUBLE)")
    found = labelled(strong, i).withColumn("racio", F.expr(m.ratio("qtd_pico", "qtd_fora")))
    if k is not None:
        found = found.orderBy(F.desc_nulls_first("racio"), F.desc("qtd_pico"), "item_id").limit(k)
    return found.select("item_id", "artigo", "codigo", "qtd_pico", "qtd_fora", "racio")


def numbered_targets(targets: DataFrame) -> DataFrame:
    """item_id, block, bit: each target's bit in a block of at most BITS targets.

    Targets are dealt into buckets by hash and numbered within their bucket, so no
    task numbers them all. The small table is stored; both its uses read the same.
    """
    ids = keep(targets.select("item_id").distinct(), "targets")
    buckets = max(1, ids.count() * 2 // BITS)
    number = F.row_number().over(W.partitionBy("bucket").orderBy("item_id")) - 1
    dealt = ids.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets))).withColumn("n", number)
    return keep(dealt.selectExpr("item_id", f"struct(bucket, n DIV {BITS} AS part) AS block", f"CAST(n % {BITS} AS INT) AS bit"), "bits")


def bundles_per_target(
    g: DataFrame, i: DataFrame, targets: DataFrame, window: w.Window, min_days: int = 1, k: int | None = None
) -> DataFrame:
    """Store-days each partner item shares with each target: pairs with at least
    min_days of them, and of each target the k partners with most (None: all).

    targets (item_id) may be any number. Each store-day carries one bit per target
    that sold there, in blocks of BITS targets; a partner adds up bits, so its
    row is repeated per block that sold there and not per target. A target also
    counts as partner of the other targets.
    """
    slots = numbered_targets(targets)
    sales = w.clip(g, window).filter(SOLD)
    flags = (
        sales.join(slots, "item_id")
        .groupBy(*STORE_DAY, "block")
        .agg(F.expr("bit_or(shiftleft(1L, bit)) AS flags"))
    )
    every_bit = range(BITS)
    shared = (
        sales.join(flags, STORE_DAY)
        .groupBy("item_id", "block")
        .agg(*columns(**{f"b{b}": f"sum(shiftright(flags, {b}) & 1L)" for b in every_bit}))
    )
    counted = shared.selectExpr(
        "item_id AS partner_id",
        "block",
        f"posexplode(array({', '.join(f'b{b}' for b in every_bit)})) AS (bit, co_occurrence_days)",
    ).filter(f"co_occurrence_days >= {max(min_days, 1)}")
    pairs = counted.join(slots.withColumnRenamed("item_id", "target_id"), ["block", "bit"]).filter("partner_id != target_id")
    if k is not None:
        rank = F.row_number().over(W.partitionBy("target_id").orderBy(F.desc("co_occurrence_days"), "partner_id"))
        pairs = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
    return (
        pairs.join(i.selectExpr("id AS partner_id", "description AS parceiro"), "partner_id")
        .join(i.selectExpr("id AS target_id", "description AS artigo"), "target_id")
        .select("artigo", "parceiro", "co_occurrence_days")
    )
