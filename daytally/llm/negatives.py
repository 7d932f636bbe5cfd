"""Hard-negative mining: for anchors and their positives the best rows of other labels in a score window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytally.llm.common import stored
from daytally.session import size_shuffles, tune


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    #: a negative's score lies between these percents of the positive's
    low: int = 30
    high: int = 90
    #: rows of one cover tree, and the rows that the space is cut up around (the first by hash)
    tree_rows: int = 4096
    pivots: int = 256
    #: anchors that are broadcast and searched for at once
    block: int = 4096


# --- cover tree ---

#: covering radius of a level, as a share of the level above
SHRINK = 1 / 1.3
#: nodes of so many rows or fewer are leaves
LEAF = 32


@dataclass
class CoverTree:
    """Rows in tree order; every node holds rows[start:stop], all within `radius` of
    its centre, which is one of them. Children of a node are children[first:last]."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray


def augmented(rows: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more component that gives all of them the length `largest`: a
    greater inner product is then a smaller distance, and the other way round."""
    rest = np.sqrt(np.maximum(largest - (rows * rows).sum(axis=1), 0.0))
    return np.c_[rows, rest]


def cover_tree(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> CoverTree:
    """Level by level: in a node with covering radius r, centres more than r * SHRINK
    apart are taken, the furthest first, until they cover all its rows within
    that; each row goes to its nearest centre. Nodes that hold rows of one place only, or
    LEAF rows, are leaves. Built from the norm-augmented rows."""
    norms = (rows * rows).sum(axis=1)
    points = augmented(rows, float(norms.max()) if len(rows) else 0.0)
    order = np.arange(len(rows))
    nodes = [[0, len(rows), 0, 0, 0]]  # start, stop, centre, first and last child
    radius = [float(np.sqrt(((points - points[0]) ** 2).sum(axis=1).max()))]
    at = 0
    while at < len(nodes):
        start, stop, _, _, _ = nodes[at]
        r = radius[at]
        if stop - start > LEAF and r > 0:
            own = order[start:stop].copy()
            p = points[own]
            # the node's centre goes on as the first centre of the level below
            chosen = [int(np.flatnonzero(own == nodes[at][2])[0])]
            near = ((p - p[chosen[0]]) ** 2).sum(axis=1)
            nearest = np.zeros(len(own), np.int64)
            while near.max() > (r * SHRINK) ** 2:
                chosen.append(int(near.argmax()))
                d = ((p - p[chosen[-1]]) ** 2).sum(axis=1)
                nearest[d < near] = len(chosen) - 1
                near = np.minimum(near, d)
            by = np.argsort(nearest, kind="stable")
            order[start:stop] = own[by]
            sizes = np.bincount(nearest, minlength=len(chosen))
            nodes[at][3], nodes[at][4] = len(nodes), len(nodes) + len(chosen)
            ends = start + np.cumsum(sizes)
            for k, c in enumerate(chosen):
                nodes.append([int(ends[k] - sizes[k]), int(ends[k]), int(own[c]), 0, 0])
                radius.append(float(np.sqrt(near[nearest == k].max())))
        at += 1
    start, stop, centre, first, last = np.array(nodes).T
    return CoverTree(ids[order], labels[order], rows[order], rows[centre], np.array(radius), start, stop, first, last)


def descend(tree: CoverTree, anchors: np.ndarray, take) -> None:
    """Best-first search for every anchor: `take(a, lo, hi)` says which of the nodes,
    whose scores lie between lo and hi, can still matter to anchor a, and
    `take.rows(a, ids, labels, scores)` gets the rows of the leaves that do.

    A score differs from its node's centre's by the anchor's length times the covering
    radius at most. Nodes are opened from the greatest upper bound down,
    doubling in number, so that what was found closes the later ones.
    """
    middle = anchors @ tree.centres.T
    # the bounds are widened by what rounding may have cost
    slack = np.sqrt((anchors * anchors).sum(axis=1))[:, None] * tree.radius[None, :] * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
    below, above = middle - slack, middle + slack
    leaf = tree.last == 0
    for a in range(len(anchors)):
        open_, step = np.zeros(1, np.int64), 8
        while len(open_):
            open_ = open_[take(a, below[a, open_], above[a, open_])]
            if not len(open_):
                break
            open_ = open_[np.argsort(-above[a, open_], kind="stable")]
            now, open_ = open_[:step], open_[step:]
            step *= 2
            inner = now[~leaf[now]]
            if len(inner):
                open_ = np.concatenate([open_, *(np.arange(tree.first[i], tree.last[i]) for i in inner.tolist())])
            ends = now[leaf[now]]
            if len(ends):
                at = np.concatenate([np.arange(tree.start[i], tree.stop[i]) for i in ends.tolist()])
                take.rows(a, tree.ids[at], tree.labels[at], tree.rows[at] @ anchors[a])


class Best:
    """The k best rows of each window of each anchor so far, whatever tree they come from.
    Anchor a's windows are lo[a, j] <= score <= hi[a, j]; of equal scores the smaller id
    is better. `alike` says whether rows of the anchor's label are wanted, or all others."""

    def __init__(self, ids, labels, lo: np.ndarray, hi: np.ndarray, k: int, alike: bool):
        self.ids, self.labels, self.lo, self.hi, self.k, self.alike = ids, labels, lo, hi, k, alike
        self.found = [[(np.zeros(0, np.int64), np.zeros(0)) for _ in row] for row in lo]
        self.floor = lo.astype(float).copy()  # a row below this can no longer be among the k best

    def __call__(self, a: int, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        return ((above[:, None] >= self.floor[a]) & (below[:, None] <= self.hi[a])).any(axis=1)

    def rows(self, a: int, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        wanted = (labels == self.labels[a]) == self.alike
        if self.alike:
            wanted &= ids != self.ids[a]
        ids, scores = ids[wanted], scores[wanted]
        for j in range(self.lo.shape[1]):
            fits = (scores >= self.floor[a, j]) & (scores <= self.hi[a, j])
            if fits.any():
                known = self.found[a][j]
                i, s = np.r_[known[0], ids[fits]], np.r_[known[1], scores[fits]]
                by = np.lexsort((i, -s))[: self.k]
                self.found[a][j] = i[by], s[by]
                if len(by) == self.k:
                    self.floor[a, j] = s[by[-1]]


# --- on Spark ---


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vec (whole numbers as double): rows with a label and a vector of finite
    components, each x as floor(256 * x). A row without vec_id takes no part either, and
    of rows that share one the first by label, then components, stands."""
    whole = "transform(embedding, x -> floor(256 * CAST(x AS DOUBLE)))"
    finite = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    good = rows.filter(f"vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {finite}")
    good = good.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(label AS BIGINT) AS label", f"transform({whole}, x -> CAST(x AS DOUBLE)) AS vec")
    return good.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("x")).select("vec_id", "x.*")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(float)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


TREE = {
    "ids": pa.binary(), "labels": pa.binary(), "rows": pa.binary(), "centres": pa.binary(), "radius": pa.binary(),
    "start": pa.binary(), "stop": pa.binary(), "first": pa.binary(), "last": pa.binary(),
}
KINDS = {"ids": np.int64, "labels": np.int64, "rows": float, "centres": float, "radius": float}


def trees(rows: DataFrame, width: int, n: int, s: Settings) -> DataFrame:
    """A stored table of cover trees, one a row. Rows go to the nearest of at most
    s.pivots pivots, so that a tree covers a small ball; the rows of a pivot
    that are too many for one tree are dealt to several by the hash of their id. So no task
    builds from more than about s.tree_rows rows, also where a third of all
    vectors are equal."""
    some = min(s.pivots, max(1, -(-n // s.tree_rows)))
    first = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(some).toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(matrix(first.column("vec"), width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            x = matrix(batch.column("vec"), width)
            near = ((pivots * pivots).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], [*batch.schema.names, "cell"])

    placed = stored(rows.mapInArrow(assign, "vec_id long, label long, vec array<double>, cell long"), "cells")
    sizes = placed.groupBy("cell").count().selectExpr("cell AS of_cell", f"CAST(ceil(count / {s.tree_rows}) AS BIGINT) AS parts")
    dealt = placed.join(F.broadcast(sizes), F.expr("cell = of_cell"))  # at most s.pivots rows
    dealt = dealt.selectExpr("vec_id", "label", "vec", "cell", "pmod(xxhash64(vec_id), parts) AS part")

    def build(table: pa.Table) -> pa.Table:
        tree = cover_tree(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("vec"), width))
        made = [getattr(tree, k).astype(KINDS.get(k, np.int64)).tobytes() for k in TREE]
        return pa.table({k: pa.array([v], pa.binary()) for k, v in zip(TREE, made, strict=True)})

    return stored(dealt.groupBy("cell", "part").applyInArrow(build, ", ".join(f"{k} binary" for k in TREE)), "trees")


def search(forest: DataFrame, width: int, block: tuple, lo: np.ndarray, hi: np.ndarray, k: int, alike: bool) -> DataFrame:
    """anchor_id, at (the window's number), vec_id, score: for every task the k best of each
    window of the block's anchors (ids, labels, vectors) in its trees."""
    shared = forest.sparkSession.sparkContext.broadcast((block, lo, hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, anchors), lo, hi = shared.value
        best = Best(ids, labels, lo, hi, k, alike)
        for batch in batches:
            for i in range(batch.num_rows):
                got = {c: np.frombuffer(batch.column(c)[i].as_buffer(), KINDS.get(c, np.int64)) for c in TREE}
                tree = CoverTree(**got | {c: got[c].reshape(-1, width) for c in ("rows", "centres")})
                descend(tree, anchors, best)
        out = [(ids[a], j, i, x) for a, row in enumerate(best.found) for j, f in enumerate(row) for i, x in zip(*f, strict=True)]
        columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[3] = arrays[3].cast(pa.int64())
        yield pa.RecordBatch.from_arrays(arrays, ["anchor_id", "at", "vec_id", "score"])

    return forest.mapInArrow(run, "anchor_id long, at long, vec_id long, score long")


def hard_negatives(rows: DataFrame, anchors: str, s: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` holds vec_id, label, embedding; `anchors` is a SQL condition on vec_id. A
    row's score is its inner product with the anchor, over whole numbers floor(256 * x).
    An anchor's positives are the s.positives best other rows of its label; for each
    of them the s.negatives best rows of other labels whose score lies within s.low
    and s.high percent of the positive's are returned, best first, ties by
    smaller vec_id. Fewer are returned where there are fewer.

    A forest of cover trees over the norm-augmented rows is built once, in parallel, and
    searched twice: for the positives, and for all windows of an anchor together.
    Each task goes through its trees best node first, keeping the best rows so far: a node
    whose bounds lie outside every window, or under the worst of them, is skipped, and
    leaves are verified on the exact numbers. Anchors are searched for in blocks of
    s.block, broadcast one after the other, so neither driver nor task holds more of
    them, and only the best rows of each task are shuffled.

    Rows with a null label, a null or empty vector, a null or non-finite component or no vec_id
    take no part; of rows with one vec_id one stands (see `usable`). Vectors of different
    lengths are compared as if the shorter ended in zeros. Scores must stay under 2^53,
    where doubles are exact; longer vectors are an error. An empty table, no anchor or
    only one label give an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    size_shuffles(spark, rows)
    good = stored(usable(rows), "vectors")
    n, width, largest = good.agg(
        F.count("*"), F.max(F.size("vec")), F.max(F.expr("aggregate(vec, 0D, (a, x) -> a + x * x)"))
    ).first()
    if n and largest >= 2.0**53:
        raise ValueError("components are too large for exact scores")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], empty)
    forest = trees(good, width, n, s)
    asked = good.filter(anchors)
    blocks = -(-asked.count() // s.block)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    results = []
    for part in range(blocks):
        got = asked.filter(F.col("part") == part).orderBy("vec_id").toArrow()
        ids, labels, x = got.column("vec_id").to_numpy(), got.column("label").to_numpy(), matrix(got.column("vec"), width)
        far = np.full((len(ids), 1), 2.0**60)
        found = search(forest, width, (ids, labels, x), -far, far, s.positives, True)
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        first = stored(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= s.positives), "positives")
        lo, hi = np.repeat(far, s.positives, axis=1), np.repeat(-far, s.positives, axis=1)  # no score fits these
        known = first.select("anchor_id", "place", "score").toArrow()  # s.positives rows an anchor of the block
        a, j = np.searchsorted(ids, known.column("anchor_id").to_numpy()), known.column("place").to_numpy() - 1
        score = known.column("score").to_numpy()
        lo[a, j], hi[a, j] = -(-s.low * score // 100), s.high * score // 100
        found = search(forest, width, (ids, labels, x), lo, hi, s.negatives, False)
        best = Window.partitionBy("anchor_id", "at").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.negatives)
        first = first.selectExpr("anchor_id AS of", "place - 1 AS j", "vec_id AS positive_id", "score AS positive_score")
        joined = found.join(first, F.expr("anchor_id = of AND at = j"))
        results.append(stored(joined.selectExpr("anchor_id", "positive_id", "rank", "vec_id AS negative_id", "positive_score", "score AS negative_score"), "negatives"))
    made = spark.createDataFrame([], empty)
    for result in results:
        made = made.unionAll(result)
    return made


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = tune(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.selectExpr("vec_id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "embedding")
    return hard_negatives(rows, "vec_id % 100 = 0")


ORACLE = r"""
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike
  WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
