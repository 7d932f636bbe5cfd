"""Induced sorting against sorting, on small texts, and on a whole shard of the given ones."""

import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from daytally.llm import suffix_array as sorting


@pytest.mark.parametrize("per_bucket", [0, 1, 1 << 12])
def test_small_texts(monkeypatch, per_bucket):
    """Both sweeps, by buckets and place by place."""
    monkeypatch.setattr(sorting, "PER_BUCKET", per_bucket)
    rng = random.Random(3)
    for _ in range(1000):
        k = rng.choice([1, 2, 3, 9])
        t = [rng.randint(1, k) for _ in range(rng.randint(1, 60))] + [0]
        assert sorting.suffix_array(np.array(t), k + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_a_whole_shard_is_sorted_by_recursion(monkeypatch):
    """Two megabytes of text go down level by level, far above the size of the sweep by buckets."""
    table = pq.read_table(Path("/root/testdata/sf0.1/documents.parquet"), columns=["text"])
    data = b"\n".join(x.encode() for x in table.column("text").to_pylist() if x)[:2_000_000]
    levels, whole = [], sorting.suffix_array

    def noted(t, size):
        levels.append((len(t), size))
        return whole(t, size)

    monkeypatch.setattr(sorting, "suffix_array", noted)
    order = noted(np.r_[np.frombuffer(data, np.uint8).astype(np.int64) + 1, 0], 257)
    assert len(levels) > 4 and levels[1][1] > 1 << 12
    assert all(2 * b <= a for (a, _), (b, _) in zip(levels, levels[1:]))
    assert (np.sort(order) == np.arange(len(data) + 1)).all()
    for k in random.Random(1).sample(range(1, len(data)), 20_000):
        assert data[order[k] :] < data[order[k + 1] :] if k < len(data) else True
