"""Items against each other: correlations among the best sellers, and cross-sell over all items.

Both count over pairs of items. A pair is never a row before it is known to
matter: tasks add up in arrays of a fixed size, and send these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daytally.functions import measures as m
from daytally.functions import windows as w
from daytally.functions.measures import columns
from daytally.operators.bundles import STORE_DAY
from daytally.operators.items import SOLD
from daytally.session import keep

# --- correlations: a blocked Gram product over store-days ---

#: items in a block of the product
BLOCK = 64
#: store-days that are multiplied at once
CHUNK = 512


def _gram(n: int):
    """A mapInArrow function from store-days (no: the items' numbers, q: whole quantities) to
    the sums of q_i * q_j that are not zero, i <= j, as hi * 2^32 + lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = -(-n // BLOCK)
        sums: dict[tuple[int, int], np.ndarray] = {}  # the upper blocks that occur, as (hi, lo)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                sizes = np.asarray(part.column("no").value_lengths())
                x = np.zeros((part.num_rows, blocks * BLOCK), np.int64)
                rows = np.repeat(np.arange(part.num_rows), sizes)
                np.add.at(x, (rows, part.column("no").flatten().to_numpy()), part.column("q").flatten().to_numpy())
                x = x.reshape(part.num_rows, blocks, BLOCK)
                held = (x != 0).any(axis=2)
                for i in range(blocks):
                    for j in range(i, blocks):
                        both = np.flatnonzero(held[:, i] & held[:, j])
                        if len(both):
                            product = x[both, i].T @ x[both, j]
                            known = sums.setdefault((i, j), np.zeros((2, BLOCK, BLOCK), np.int64))
                            known[0] += product >> 32
                            known[1] += product & 0xFFFFFFFF
        for (i, j), (hi, lo) in sums.items():
            a, b = np.nonzero((hi != 0) | (lo != 0))
            upper = i * BLOCK + a <= j * BLOCK + b
            a, b = a[upper], b[upper]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i * BLOCK + a), pa.array(j * BLOCK + b), pa.array(hi[a, b]), pa.array(lo[a, b])], ["i", "j", "hi", "lo"]
            )

    return run


def correlation_matrix(g: DataFrame, i: DataFrame, window: w.Window, top: int = 100) -> DataFrame:
    """Pearson correlation of the quantities of every two of the `top` items that sell most
    in the window (ties by id), over its store-days; artigo comes before outro by rank.

    A store-day is one that has any fact. An item without a fact there counts as zero,
    which is implied: only what was sold is multiplied. Items go by their numbers
    into blocks, and each task adds up the products of the upper blocks for its
    store-days, so a store-day with all items is one row like any other; a task holds
    and sends at most top * (top + 1) / 2 sums. `top` is meant for up to some
    thousand items. An item whose quantity never changes has no correlation.

    Quantities are exact to five decimals, and so are all sums.
    """
    facts = w.clip(g, window).filter("total_quantity IS NOT NULL")
    totals = facts.groupBy("item_id").agg(*columns(x="sum(total_quantity)")).orderBy(F.desc("x"), "item_id").limit(top)
    best = keep(totals.withColumn("no", F.row_number().over(W.orderBy(F.desc("x"), "item_id")) - 1), "top_items")  # `top` rows
    n = facts.select(*STORE_DAY).distinct().count()
    sold = facts.join(F.broadcast(best.select("item_id", "no")), "item_id")
    baskets = sold.groupBy(*STORE_DAY).agg(
        F.expr("collect_list(CAST(no AS BIGINT)) AS no"), F.expr("collect_list(CAST(total_quantity * 100000 AS BIGINT)) AS q")
    )
    made = baskets.select("no", "q").mapInArrow(_gram(max(1, best.count())), "i long, j long, hi long, lo long")
    whole = "CAST(sum(hi) AS DECIMAL(38,0)) * 4294967296 + CAST(sum(lo) AS DECIMAL(38,0))"
    sums = keep(made.groupBy("i", "j").agg(F.expr(f"CAST({whole} AS DOUBLE) / 1e10 AS xy")), "gram")
    named = best.join(i.selectExpr("id AS item_id", "description"), "item_id")

    def side(no: str, name: str, x: str, xx: str) -> DataFrame:
        squares = sums.filter("i = j").selectExpr(f"i AS {no}", f"xy AS {xx}")
        # an item of quantity zero has no square
        return named.selectExpr(f"CAST(no AS BIGINT) AS {no}", f"description AS {name}", f"CAST(x AS DOUBLE) AS {x}").join(squares, no, "left")

    # what rounding leaves of a spread of zero is no spread
    spread = f"(CASE WHEN {n} * xx - x * x > 1e-9 * {n} * xx AND {n} * yy - y * y > 1e-9 * {n} * yy THEN sqrt(({n} * xx - x * x) * ({n} * yy - y * y)) END)"
    pairs = side("i", "artigo", "x", "xx").join(side("j", "outro", "y", "yy"), F.expr("i < j"))  # top * top / 2 rows, the result
    return (
        pairs.join(sums, ["i", "j"], "left")
        .na.fill(0.0, ["xx", "yy", "xy"])
        .select("artigo", "outro", *columns(correlacao=m.rounded(f"({n} * xy - x * y) / {spread}", 4)))
    )


# --- cross-sell: pairs counted behind a filter of hash buckets ---

BASKETS = {"day": "date", "week": "trunc(date, 'week')", "month": "trunc(date, 'month')"}
#: frequent items of one basket that are paired in one row; a larger basket is cut up
TOGETHER = 256
#: buckets that pairs are counted in first
BUCKETS = 1 << 22


def _pairs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The pairs (smaller, larger id) of each row's items, or of its two parts' items."""
    for parts in batch.column("parts").to_pylist():
        first = np.array(parts[0], np.int64)
        if len(parts) == 1:
            a, b = np.triu_indices(len(first), 1)
            a, b = first[a], first[b]
        else:
            second = np.array(parts[1], np.int64)
            a, b = np.repeat(first, len(second)), np.tile(second, len(first))
        yield np.stack([np.minimum(a, b), np.maximum(a, b)])


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    a, b = pairs.astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _frequent_buckets(baskets: DataFrame, buckets: int, least: int, block: int = 1 << 14) -> np.ndarray:
    """Which buckets hold `least` pairs or more: counted in an array in each task, sent in
    compressed blocks and added up block by block; a bit each comes to the driver."""

    def count(batches):
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for pairs in _pairs(batch):
                np.add.at(own, _bucket(pairs, buckets), 1)
        for at in range(0, buckets, block):
            part = own[at : at + block]
            if part.any():
                packed = zstandard.ZstdCompressor(1).compress(part.tobytes())
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "n": pa.array([packed], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(n), np.int64)
                sums[at] = sums[at] + part if at in sums else part
        for at, part in sums.items():
            bits = np.packbits(part >= least).tobytes()
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "n": pa.array([bits], pa.binary())})

    schema = "at long, n binary"
    got = baskets.select("parts").mapInArrow(count, schema).repartition("at").mapInArrow(add, schema).toArrow()
    out = np.zeros(buckets, bool)
    for at, bits in zip(got.column("at").to_pylist(), got.column("n").to_pylist(), strict=True):
        kept = np.unpackbits(np.frombuffer(bits, np.uint8))[: min(block, buckets - at)].astype(bool)
        out[at : at + len(kept)] = kept
    return out


def cross_sell(
    g: DataFrame, i: DataFrame, window: w.Window, least: int = 10, basket: str = "day", buckets: int = BUCKETS, together: int = TOGETHER
) -> DataFrame:
    """Every two items that sell in the same basket at least `least` times: number of baskets
    with both, the share of each one's baskets that has the other, and lift.

    A basket is a store's day, week or month. Lift is how many times as often the two meet as
    they would by chance. artigo is the item with the smaller id.

    Exact, in two passes. Items in fewer than `least` baskets are left out first, as no
    pair of theirs can reach it. Then all pairs are counted by hash bucket, in an array of
    a fixed size; only pairs of buckets that reach `least` become rows and are
    counted by themselves. More pairs than the buckets can tell apart let more rows pass,
    which changes no result. A basket of more than `together` frequent items is cut
    into parts by hash, and every two parts meet in a row of their own, so the basket
    of a very large store is spread over many tasks; its pairs are all counted, which
    is quadratic in its items and why `least` should grow with the baskets.
    """
    sold = w.clip(g, window).filter(SOLD)
    sold = sold.selectExpr("store_id", f"{BASKETS[basket]} AS period", "item_id").distinct()
    sold = keep(sold, "sold")
    total = sold.select("store_id", "period").distinct().count()
    support = keep(sold.groupBy("item_id").agg(*columns(n="count(*)")).filter(f"n >= {least}"), "support")
    often = sold.join(support.select("item_id"), "item_id")
    sizes = often.groupBy("store_id", "period").agg(F.expr(f"CAST(ceil(count(*) / {together}) AS BIGINT) AS parts"), F.count("*").alias("k"))
    placed = often.join(sizes.filter("k > 1"), ["store_id", "period"])
    placed = placed.selectExpr("*", "pmod(xxhash64(item_id), parts) AS part")
    # a part meets itself and every other one; both are named by the smaller and the larger number
    spread = placed.selectExpr("*", "explode(sequence(0L, parts - 1L)) AS other")
    spread = spread.selectExpr("store_id", "period", "least(part, other) AS a", "greatest(part, other) AS b", "part", "item_id")
    lists = spread.groupBy("store_id", "period", "a", "b", "part").agg(F.collect_list("item_id").alias("ids"))
    lists = lists.groupBy("store_id", "period", "a", "b").agg(F.collect_list("ids").alias("parts"))
    baskets = keep(lists.filter("a = b OR size(parts) = 2").select("parts"), "baskets")
    passes = _frequent_buckets(baskets, buckets, least)
    shared = g.sparkSession.sparkContext.broadcast(np.packbits(passes))

    def emit(batches):
        kept = np.unpackbits(shared.value)
        for batch in batches:
            found = [p[:, kept[_bucket(p, buckets)] > 0] for p in _pairs(batch)]
            pairs, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True) if found else (np.zeros((2, 0), np.int64), [])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n, pa.int64())], ["a", "b", "n"])

    both = baskets.mapInArrow(emit, "a long, b long, n long").groupBy("a", "b").agg(*columns(n="sum(n)")).filter(f"n >= {least}")
    label = i.selectExpr("id AS item_id", "description").join(support, "item_id")
    both = both.join(label.selectExpr("item_id AS a", "description AS artigo", "n AS na"), "a")
    both = both.join(label.selectExpr("item_id AS b", "description AS outro", "n AS nb"), "b")
    return both.select(
        "artigo",
        "outro",
        *columns(
            cestos="n",
            confianca_pct=m.rounded("n * 100 / na"),
            confianca_inversa_pct=m.rounded("n * 100 / nb"),
            lift=m.rounded(f"CAST(n AS DOUBLE) * {total} / (CAST(na AS DOUBLE) * CAST(nb AS DOUBLE))", 4),
        ),
    )
