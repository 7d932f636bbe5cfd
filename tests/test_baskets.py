"""Items against items, local events and margin groupings on small tables, against plain versions."""

import math
import random
from collections import Counter
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
from helpers import item_days, items, rows, store_days, stores

from daytally.functions.calendar import calendar
from daytally.functions.windows import year_of
from daytally.operators import baskets, periods
from daytally.operators.items import margin_cube, totals_of_terms

YEAR = year_of(2024)


@pytest.fixture(scope="module")
def sales():
    """Twelve items over 40 store-days, one of which sells every item; some returns and zeros."""
    rng = random.Random(1)
    made = []
    for day in range(20):
        for store in (1, 2):
            sold = range(1, 13) if (day, store) == (3, 1) else [i for i in range(1, 13) if rng.random() < 0.3]
            for i in sold:
                made.append((i, store, str(date(2024, 1, 1) + timedelta(days=day * 9)), rng.choice([-1, 0, 1, 2.5, 3, 4]), 5, 1))
    return made


@pytest.mark.parametrize(("top", "block", "chunk"), [(5, 64, 512), (12, 4, 3), (50, 5, 1)])
def test_correlation_matrix(spark, sales, monkeypatch, top, block, chunk):
    monkeypatch.setattr(baskets, "BLOCK", block)
    monkeypatch.setattr(baskets, "CHUNK", chunk)
    days = sorted({(s, d) for _, s, d, *_ in sales})
    vectors = {i: np.zeros(len(days)) for i in range(1, 13)}
    for i, s, d, q, *_ in sales:
        vectors[i][days.index((s, d))] += q
    best = sorted(vectors, key=lambda i: (-vectors[i].sum(), i))[:top]
    want = {(f"item {a}", f"item {b}"): np.corrcoef(vectors[a], vectors[b])[0, 1] for a, b in combinations(best, 2)}
    found = baskets.correlation_matrix(item_days(spark, *sales), items(spark, *range(1, 13)), YEAR, top)
    got = {(a, b): float(r) for a, b, r in rows(found)}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=6e-5) for p in want)


def test_correlation_of_what_never_changes(spark):
    facts = item_days(spark, (1, 1, "2024-01-01", 2, 1, 1), (1, 1, "2024-01-02", 2, 1, 1), (2, 1, "2024-01-01", 2, 1, 1))
    assert rows(baskets.correlation_matrix(facts, items(spark, 1, 2), YEAR)) == [("item 1", "item 2", None)]
    assert rows(baskets.correlation_matrix(facts.limit(0), items(spark, 1, 2), YEAR)) == []


def test_exact_sums_of_large_quantities(spark):
    """Products that pass 2^53 in a chunk are still added exactly."""
    import pyarrow as pa

    q = 3_000_000_019
    batch = pa.RecordBatch.from_pydict({"no": pa.array([[0, 1]] * 9, pa.list_(pa.int64())), "q": pa.array([[q, -q]] * 9, pa.list_(pa.int64()))})
    [made] = list(baskets._gram(2)(iter([batch.slice(0, 1)] * 9)))
    sums = {(i, j): hi * 2**32 + lo for i, j, hi, lo in zip(*(made.column(c).to_pylist() for c in ("i", "j", "hi", "lo")))}
    assert sums == {(0, 0): 9 * q * q, (0, 1): -9 * q * q, (1, 1): 9 * q * q}


@pytest.mark.parametrize(("least", "basket", "buckets", "together"), [(1, "day", 8, 3), (3, "month", 1 << 16, 256), (4, "day", 64, 2), (2, "week", 16, 4)])
def test_cross_sell(spark, sales, least, basket, buckets, together):
    def period(day):
        d = date.fromisoformat(day)
        return {"day": d, "week": d - timedelta(days=d.weekday()), "month": d.replace(day=1)}[basket]

    held = {}
    for i, s, d, q, *_ in sales:
        if q > 0:
            held.setdefault((s, period(d)), set()).add(i)
    single = Counter(i for x in held.values() for i in x)
    pairs = Counter(p for x in held.values() for p in combinations(sorted(x), 2))
    want = [
        (f"item {a}", f"item {b}", n, round(100 * n / single[a], 2), round(100 * n / single[b], 2), round(n * len(held) / single[a] / single[b], 4))
        for (a, b), n in pairs.items()
        if n >= least
    ]
    found = baskets.cross_sell(item_days(spark, *sales), items(spark, *range(1, 13)), YEAR, least, basket, buckets, together)
    got = [(a, b, n, *map(float, rest)) for a, b, n, *rest in rows(found)]
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)] and want
    assert all(math.isclose(x, y, abs_tol=0.011) for r, t in zip(sorted(got), sorted(want)) for x, y in zip(r[3:], t[3:]))


def test_only_pairs_of_frequent_buckets_become_rows(spark, monkeypatch):
    """Two hundred pairs that meet once, one that meets three times."""
    facts = [(i, 1, f"2024-01-{1 + i // 20:02d}", 1, 1, 1) for i in range(1, 200)]
    facts += [(i, 2, f"2024-03-0{d}", 1, 1, 1) for i in (900, 901) for d in (1, 2, 3)]
    facts += [(i, 3, f"2024-02-{1 + i % 9:02d}", 1, 1, 1) for i in range(1, 200)]
    seen = []
    pairs = baskets._frequent_buckets
    monkeypatch.setattr(baskets, "_frequent_buckets", lambda *a: seen.append(pairs(*a)) or seen[-1])
    found = baskets.cross_sell(item_days(spark, *facts), items(spark, *range(1, 902)), YEAR, 3)
    assert rows(found, "artigo", "outro", "cestos") == [("item 900", "item 901", 3)]
    assert seen[0].sum() == 1


def test_local_events(spark, monkeypatch):
    """São João in Porto and Braga, 23 and 24 June; Porto stands for a hot place that is split."""
    monkeypatch.setattr(periods, "STORES_TOGETHER", 2)
    places = stores(spark, *[(s, f"s{s}", 1, "North") for s in range(1, 8)], (8, "s8", 1, "East"), (9, "s9", 0, "North"), (10, "s10", 1, "West"))
    facts = [(s, f"2024-06-{d}", 10 * s, 1) for s in range(1, 11) for d in (22, 23, 24, 25)] + [(8, "2023-06-24", 7, 2), (8, "2024-08-31", 1, 1)]
    cities = {"Porto": ["North"], "Braga": ["North", "East"], "Nowhere": ["West"]}
    cal = calendar(spark, range(2022, 2025))
    found = periods.local_event_sales(store_days(spark, *facts), places, cal, cities)
    assert {e for (e,) in rows(found, "event")} == {"São João", "São João (pico)"}
    found = found.filter("event = 'São João'")
    assert rows(found, "event", "location", "start", "dias", "lojas_dia", "total_vendas", "vendas_sem_iva") == [
        ("São João", "East", date(2023, 6, 23), 1, 1, 2, 7),
        ("São João", "East", date(2024, 6, 23), 2, 2, 2, 160),
        ("São João", "North", date(2024, 6, 23), 2, 14, 14, 560),
    ]
    assert rows(periods.local_event_sales(store_days(spark, *facts).limit(0), places, cal, cities)) == []
    assert rows(periods.local_event_sales(store_days(spark, *facts), places, cal, {"Porto": []} | {"X": ["North"]})) == []


def test_margin_cube_and_terms(spark):
    facts = item_days(spark, (1, 1, "2024-01-01", 1, 10, 4), (4, 1, "2024-01-01", 2, 20, 4), (2, 2, "2024-02-01", 1, 5, 9), (1, 2, "2024-02-02", 1, 10, 4))
    args = items(spark, 1, 2, 4), stores(spark, (1, "a", 1), (2, "b", 0)), YEAR
    cube = {r[:4]: r[4:] for r in rows(margin_cube(facts, *args), "nivel", "family_id", "loja", "mes", "lojas_dia", "receita", "margem")}
    assert cube[7, None, None, None] == (3, 45, 20)
    assert cube[3, 1, None, None] == (2, 40, 24) and cube[3, 2, None, None] == (1, 5, -4)  # items 1 and 4 are one family
    assert cube[1, 1, "a", None] == (1, 30, 18) and cube[5, None, "b", None] == (2, 15, 2)
    assert cube[2, 1, None, date(2024, 2, 1)] == (1, 10, 6) and cube[6, None, None, date(2024, 1, 1)] == (1, 30, 18)
    some = rows(margin_cube(facts, *args, store_ids=[2], item_ids=[1, 2], families=[2]), "nivel", "receita")
    assert sorted(some) == [(1, 5), (2, 5), (3, 5), (5, 5), (6, 5), (7, 5)]
    terms = {(t, m.month): x for m, t, x in rows(totals_of_terms(facts, ["Vendas", "margem"], YEAR), "mes", "termo", "total")}
    assert terms == {("Vendas", 1): 30, ("Vendas", 2): 15, ("margem", 1): 18, ("margem", 2): 6 - 4}
    with pytest.raises(KeyError):
        totals_of_terms(facts, ["lucro"], YEAR)
