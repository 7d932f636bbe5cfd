"""Periodic runs, decontamination and hard negatives against plain versions."""

import math
import random

import numpy as np
import pytest
from brute import negatives as plain_negatives, periodic as plain_periodic, runs as plain_runs, spans as plain_spans
from pyspark.sql import functions as F
from test_operators import got, prose, table, want

from daytally.llm import decontaminate, negatives, periodic
from daytally.llm.common import numbered

# --- periodic runs ---


def test_wavelet_tree_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 65, 300):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values)
        lo = rng.integers(0, n + 1, 200)
        hi = np.array([rng.integers(x, n + 1) for x in lo])
        x = rng.integers(0, n + 3, 200)
        plain = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(lo, hi, x)]
        assert tree.successor(lo, hi, x).tolist() == plain


def test_runs_of_sequences():
    rng = random.Random(2)
    for _ in range(1500):
        words = []
        for _ in range(rng.randint(0, 8)):
            unit = [rng.randint(0, rng.choice([1, 2, 6])) for _ in range(rng.randint(1, 12))]
            words += (unit * 8)[: rng.randint(1, 8 * len(unit))]
        assert periodic.find_runs(np.array(words, np.int64), len(words)) == plain_runs(words), words


@pytest.fixture(scope="module")
def looping():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\x0b\n"), (4, "a"), (5, "a " * 5), (6, "a " * 6), (7, "a b " * 3 + "a"), (8, "a b " * 4)]
    rows += [(9, "é ü x é ü x\té ü x\né ü x"), (10, "A a " * 4), (11, "x " * 40000), (12, prose(rng, 30000)), (None, "a b " * 9)]
    rows += [(13, "a b a b a b a b a a a a a a"), (14, "x y z " * 4 + "q " + "x y z " * 4), (15, "u " * 7 + "v " * 7), (6, "a " * 6)]
    for d in range(100, 260):  # one in ten of these is altered by its id
        unit = prose(rng, rng.randint(1, 9))
        rows.append((d, " ".join([prose(rng, rng.randint(0, 9)), *[unit] * rng.randint(1, 7), prose(rng, rng.randint(0, 40))])))
    return rows


PERIODIC = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_periodic_runs(spark, looping, tmp_path):
    table(spark, looping).write.parquet(f"{tmp_path}/documents.parquet")
    df = periodic.op11_periodic_runs(spark, str(tmp_path))
    assert got(df, *PERIODIC) == want([(d, *plain_periodic(d, t)) for d, t in looping])


def test_runs_and_collapsed_text(spark):
    rows = table(spark, [(1, "so la la la la la la\nli  li"), (2, "one two")])
    found = {r["doc_id"]: r for r in periodic.periodic_runs(rows).collect()}
    assert found[1]["runs"] == [(1, 6, 1)] and found[1]["collapsed"] == "so la li li"
    assert found[2]["runs"] == [] and found[2]["collapsed"] == "one two"
    assert periodic.periodic_runs(rows.limit(0)).collect() == []


def test_bundles_do_not_join_texts(spark, monkeypatch):
    """Texts laid end to end repeat one another; no run goes over an end."""
    rows = [(d, "a b " * (d % 5)) for d in range(40)]
    found = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(table(spark, rows).coalesce(1)).collect()}
    assert found == {d: plain_runs(t.split()) for d, t in rows}


# --- decontamination ---

ITEMS = [(1, "One two three, four FIVE six"), (2, "two three four five six seven"), (10, "  "), (3, None), (4, "lone"), (5, "lone"), (6, "é ü ñ 1 2")]


@pytest.fixture(scope="module")
def leaky():
    rows = [(1, None), (2, ""), (3, "!? \n"), (4, "one two three four"), (5, "zero ONE-two\nthree four. five six seven! eight"), (6, "lone")]
    rows += [(7, "a lone b LONE c"), (8, "É ü ñ 1 2"), (9, "é.ü.ñ.1.2."), (None, "two three four five"), (4, "one two three four")]
    rows += [(11, "x " * 30000 + "two three four five " * 3), (12, "(one two three four) five"), (13, "two three four five" * 2)]
    rng = random.Random(4)
    rows += [(d, prose(rng, rng.randint(0, 60), "one two three four five six seven lone x y".split())) for d in range(20, 60)]
    return rows


def contaminated(docs, items, size, at_once=decontaminate.AT_ONCE):
    rows = numbered(docs.select(F.col("doc_id").alias("kept"), "text"), "kept", "text")
    return decontaminate.contamination(rows, items, size, at_once)


@pytest.mark.parametrize(("size", "at_once"), [(4, 1 << 20), (4, 3), (1, 2), (10, 1 << 20)])
def test_contamination(spark, leaky, size, at_once):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = contaminated(table(spark, leaky), items, size, at_once)
    found = [(r["kept"], r["n_words"], r["n_hit"], [i for a, b in r["spans"] for i in range(a, b)], r["items"]) for r in df.collect()]
    plain = [(d, n, len(hit), sorted(hit), named) for d, t in leaky for n, hit, named in [plain_spans(t, ITEMS, size)]]
    assert want(found) == want(plain)


def test_decontamination_query(spark, leaky, tmp_path):
    table(spark, leaky).write.parquet(f"{tmp_path}/documents.parquet")
    items = [*ITEMS, (30, "two three four five " * 3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = got(decontaminate.op12_decontamination(spark, str(tmp_path)), "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    plain = [(d, n, len(hit), len(named), len(hit) > 0) for d, t in leaky for n, hit, named in [plain_spans(t, items, 10)]]
    assert found == want(plain) and any(r[4] for r in found)


def test_spans_and_documents_are_removed(spark, leaky):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(spark, leaky)
    cut = decontaminate.decontaminated(docs, items, "spans", 4)
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[5] == "zero ! eight" and texts[6] == "" and texts[7] == "a  b  c" and texts[12] == "(" and texts[1] is None and texts[3] == "!? \n"
    hit = [bool(plain_spans(t, ITEMS, 4)[1]) for _, t in leaky]
    left = decontaminate.decontaminated(docs, items, "documents", 4)
    assert got(left, "doc_id", "text") == want([r for r, h in zip(leaky, hit) if not h])
    clean = {d for (d, _), h in zip(leaky, hit) if not h}
    assert all(texts[d] == t for d, t in leaky if d in clean)
    again = contaminated(cut.filter("doc_id > 19"), items, 4)  # what is left may meet anew across a gap, never inside one
    assert again.count() == 40
    with pytest.raises(ValueError):
        decontaminate.decontaminated(docs, items, "words")


def test_empty_benchmark_and_table(spark, leaky):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, leaky)
    assert got(decontaminate.decontaminated(docs, items), "doc_id", "text") == want(leaky)
    assert contaminated(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string"), 10).collect() == []


# --- hard negatives ---

VECTORS = "vec_id long, label int, embedding array<float>, n int, score string, at int, cell long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, 3) for r in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def placed():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.3) for x in c] if i % 3 else list(centres[0])  # a third are one vector
        rows.append((i, rng.randint(0, 2), v))
    rows += [(1000, None, [1.0] * 6), (1001, 1, None), (1002, 1, [1.0, None, 1.0]), (1003, 1, [math.nan] * 6), (1004, 1, [math.inf] * 6)]
    rows += [(1005, 1, []), (1006, 1, [2.0, 1.0]), (1007, 0, [0.0] * 6), (None, 1, [1.0] * 6), (10, 2, rows[10][2]), (20, 0, [0.5] * 6), (1010, 7, [1.0] * 6)]
    rows.append(rows[30])
    return [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]


NEGATIVES = "anchor_id positive_id rank negative_id positive_score negative_score".split()


@pytest.mark.parametrize("s", [negatives.Settings(), negatives.Settings(tree_rows=16, pivots=3, block=7), negatives.Settings(positives=2, negatives=3, low=-50, high=100)])
def test_hard_negatives(spark, placed, s):
    found = negatives.hard_negatives(vectors(spark, placed), "vec_id % 10 = 0", s)
    plain = plain_negatives(placed, lambda i: i % 10 == 0, s.positives, s.negatives, s.low, s.high)
    assert sorted(tuple(r) for r in found.select(*NEGATIVES).collect()) == plain and plain


def test_hard_negatives_of_little(spark, placed):
    rows = vectors(spark, placed)
    assert negatives.hard_negatives(rows.limit(0), "vec_id = 1").collect() == []
    assert negatives.hard_negatives(rows, "vec_id = -1").collect() == []
    assert negatives.hard_negatives(rows.filter("label = 0"), "true").collect() == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(vectors(spark, [(1, 1, [3e7, 1.0])]), "true")


def test_cover_tree_holds_its_bounds(placed):
    rows = np.array([v for _, label, v in placed if label is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)])
    tree = negatives.cover_tree(np.arange(len(rows)), np.zeros(len(rows), int), rows)
    seen = np.zeros(len(rows), int)
    for i in range(len(tree.start)):
        inside = tree.rows[tree.start[i] : tree.stop[i]]
        assert np.sqrt(((inside - tree.centres[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        children = range(tree.first[i], tree.last[i])
        if children:
            assert (tree.start[tree.first[i]], tree.stop[tree.last[i] - 1]) == (tree.start[i], tree.stop[i])
            assert all(tree.radius[c] <= tree.radius[i] * negatives.SHRINK + 1e-9 for c in children)
        else:
            seen[tree.start[i] : tree.stop[i]] += 1
    assert (seen == 1).all()


def test_a_descent_skips_nodes():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(c, 0.05, (200, 8)) for c in rng.normal(0, 3, (20, 8))])
    tree = negatives.cover_tree(np.arange(len(rows)), np.zeros(len(rows), int), rows)
    best = negatives.Best(np.array([-1]), np.array([0]), np.array([[-1e18]]), np.array([[1e18]]), 5, True)
    read = []
    add = best.rows
    best.rows = lambda a, ids, *more: (read.append(len(ids)), add(a, ids, *more))
    negatives.descend(tree, rows[:1], best)
    scores = rows @ rows[0]
    assert best.found[0][0][0].tolist() == np.argsort(-scores)[:5].tolist() and sum(read) < len(rows) / 3

