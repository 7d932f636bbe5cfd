"""Suffix-array dedup: bytes covered by a string of a given length that starts elsewhere too."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.llm.common import documents, each, in_filter, met_twice, stored, texts
from daytally.llm.ngram_join import mixed, powers
from daytally.llm.suffix_array import common_prefixes, suffix_array

#: places are packed beside hashes in one number; longer texts are done in pieces
PIECE = 1 << 22
PLACE = np.uint64((1 << 24) - 1)


def sums_of(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    power, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the substrings from first to last."""
    _, back = powers(len(sums))
    return mixed((sums[last] - sums[first]) * back[first])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cut the starts of strings of `length` bytes into runs: anchor hash, digest of
    the run's bytes, first start, last start.

    The anchor of a string is the piece of a fifth of its length with the smallest
    hash, the first of such. It depends on the string alone, so equal strings have
    equal anchors at equal places. Neighbouring starts share anchors; a run's bytes
    reach from its first start to the end of the string at its last.
    """
    out = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[begin : begin + PIECE + length - 1]
        k, width = length // 5, length - length // 5 + 1
        sums = sums_of(part)
        at = np.arange(len(part) - k + 1)
        pieces = hashes(sums, at, at + k)
        coded = (pieces & ~PLACE) | at.astype(np.uint64)
        # smallest of each window: blocks of the window's width, from both sides
        pad = -len(coded) % width
        blocks = np.r_[coded, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))].reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], n] - 1
        place = place[first]
        shape = (place - first) * length + (last - first)
        digest = mixed(hashes(sums, first, last + length) + mixed(shape.astype(np.uint64)))
        out.append((pieces[place].view(np.int64), digest.view(np.int64), first + begin, last + begin))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


def starts_to_spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The spans that strings of `length` bytes cover, from their ascending starts."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


SPANS = "row long, first long, last long"
FRAGMENTS = "anchor long, digest long, n long, row long, first long, last long, data binary"


def _shard_spans(length: int):
    """Spans from the fragments of a shard by its suffix array."""

    def run(table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x, np.uint8) for x in table.column("data").to_pylist()]
        n, row, first, last = (np.asarray(table.column(c).to_numpy()) for c in ("n", "row", "first", "last"))
        ends = np.cumsum([len(x) for x in data])
        text = np.concatenate(data)
        starts = ends - [len(x) for x in data]
        of = np.repeat(np.arange(len(data)), last - first + 1)
        valid = np.zeros(len(text), bool)
        at = np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + starts[of]
        valid[at] = True
        fragment = np.zeros(len(text), np.int64)
        fragment[at] = of
        order = suffix_array(np.r_[text.astype(np.int64) + 1, 0], 257)[1:]
        order = order[valid[order]]
        shared = common_prefixes(text, order, length)[order] >= length
        again = shared | np.r_[shared[1:], False]  # equal to the one sorted before or after
        again = order[again & (n[fragment[order]] == 1)]
        out = ([], [], [])
        again.sort()
        owner = fragment[again]
        for i, j in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(owner)]))(np.flatnonzero(np.diff(owner)) + 1), strict=True):
            if i < j:
                f = owner[i]
                for a, b in starts_to_spans(again[i:j] - starts[f] + first[f], length):
                    out[0].append(row[f]), out[1].append(a), out[2].append(b)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("row", "first", "last"), out, strict=True)})

    return run


def _window_hashes(length: int):
    """A row per start of each fragment, for anchors too frequent for a shard."""

    def one(batch):
        h, row, start, n = [], [], [], []
        for x, r, i, j, k in zip(*(batch.column(c).to_pylist() for c in ("data", "row", "first", "last", "n")), strict=True):
            sums = sums_of(np.frombuffer(x, np.uint8))
            at = np.arange(j - i + 1)
            h.append(hashes(sums, at, at + length).view(np.int64))
            start.append(at + i)
            row.append(np.full(len(at), r)), n.append(np.full(len(at), k))
        return [pa.array(np.concatenate(x), pa.int64()) for x in (h, row, start, n)]

    return each(one, {"h": pa.int64(), "row": pa.int64(), "start": pa.int64(), "n": pa.int64()})


def repeated_spans(keyed: DataFrame, length: int, shard_bytes: int, most_fragments: int) -> DataFrame:
    """row, first, last of spans that repeated strings cover; keyed has row, text."""

    def anchor_hashes(batch):
        return [pa.array(np.concatenate([anchors(np.frombuffer(t, np.uint8), length)[0] for t in texts(batch)]))]

    bits = met_twice(keyed.mapInArrow(each(anchor_hashes, {"h": pa.int64()}), "h long"))
    shared = keyed.sparkSession.sparkContext.broadcast(bits)

    def runs(batch):
        made = ([], [], [], [], [])
        for r, t in zip(batch.column("row").to_pylist(), texts(batch), strict=True):
            found = anchors(np.frombuffer(t, np.uint8), length)
            keep = np.flatnonzero(in_filter(shared.value, found[0])) if len(found[0]) else np.zeros(0, np.int64)
            for column, v in zip(made, (*found, np.zeros(len(found[0]), np.int64) + r), strict=True):
                column.append(v[keep])
        return [pa.array(np.concatenate(x), pa.int64()) for x in made]

    columns = dict.fromkeys(("anchor", "digest", "first", "last", "row"), pa.int64())
    runs_of = stored(keyed.mapInArrow(each(runs, columns), "anchor long, digest long, first long, last long, row long"), "runs")
    kinds = runs_of.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("x"))
    kinds = stored(kinds.select("anchor", "digest", "n", "x.*"), "kinds")

    # a run met twice as a whole: all its strings are repeated, wherever it stands
    twice = stored(kinds.filter("n > 1").select(F.col("digest").alias("d"), F.col("anchor").alias("a")), "twice")
    whole = runs_of.join(twice, F.expr("digest = d AND anchor = a")).select("row", "first", (F.col("last") + length).alias("last"))

    # anchors with different runs, of which one is met once: their bytes must be compared
    open_anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.expr("IF(n = 1, 1, 0)")).alias("single"))
    open_anchors = stored(open_anchors.filter("kinds > 1 AND single > 0").select(F.col("anchor").alias("a"), "kinds"), "open_anchors")
    needed = stored(kinds.join(open_anchors, F.expr("anchor = a")).drop("a"), "needed")
    wanted = needed.groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "n", "kinds", "first", "last")).alias("cuts"))
    wanted = wanted.withColumnRenamed("row", "of")
    squeeze = zstandard.ZstdCompressor

    def packed(batch):
        c = squeeze(3)
        return [batch.column("row"), [c.compress(t) for t in texts(batch)]]

    packs = keyed.mapInArrow(each(packed, {"row": pa.int64(), "packed": pa.binary()}), "row long, packed binary")

    def cut(batch):
        grow, out = zstandard.ZstdDecompressor(), tuple([] for _ in range(8))
        for r, x, cuts in zip(*(batch.column(c).to_pylist() for c in ("row", "packed", "cuts")), strict=True):
            data = grow.decompress(x)
            for c in cuts:
                v = (c["anchor"], c["digest"], c["n"], r, c["first"], c["last"], data[c["first"] : c["last"] + length], c["kinds"])
                for column, y in zip(out, v, strict=True):
                    column.append(y)
        return out

    types = dict.fromkeys(("anchor", "digest", "n", "row", "first", "last"), pa.int64()) | {"data": pa.binary(), "kinds": pa.int64()}
    fragments = packs.join(wanted, F.expr("row = of")).select("row", "packed", "cuts")
    fragments = fragments.mapInArrow(each(cut, types), FRAGMENTS + ", kinds long").dropDuplicates(["anchor", "digest"])
    fragments = stored(fragments, "fragments")

    usual, frequent = fragments.filter(F.col("kinds") <= most_fragments), fragments.filter(F.col("kinds") > most_fragments)
    size = usual.agg(F.sum(F.length("data"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(1 + size // shard_bytes)).alias("shard")
    sorted_spans = usual.select(shard, "n", "row", "first", "last", "data").groupBy("shard").applyInArrow(_shard_spans(length), SPANS)

    windows = stored(frequent.mapInArrow(_window_hashes(length), "h long, row long, start long, n long"), "windows")
    met = stored(windows.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("h").alias("met")), "met")
    single = windows.filter("n = 1").join(met, F.expr("h = met"))
    window_spans = single.select("row", F.col("start").alias("first"), (F.col("start") + length).alias("last"))
    return whole.unionAll(sorted_spans).unionAll(window_spans)


def remove_repeats(
    docs: DataFrame, length: int = 200, shard_bytes: int = 2 << 20, most_fragments: int = 4096, digests: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay: `kept` (binary)
    or, with digests, kept_sha256.

    Every byte of a text (UTF-8) goes that is covered by a string of `length` bytes
    which also starts anywhere else, in the same document or another; matches end
    with their documents, and all are judged on the input.

    1. Strings are told apart by anchors (`anchors`), which equal strings share. A
       Bloom filter drops anchors met once in the corpus: nothing they
       belong to is repeated. What remains is collapsed by anchor and bytes, so that
       copies, however many, are one run from there on.
    2. Where runs with one anchor differ, their bytes go to shards by anchor. A
       shard's suffix array is built by induced sorting, and the permuted
       common prefixes say which strings are equal to a neighbour.
    3. An anchor with more than most_fragments different runs would be too much
       for one shard: its strings are counted by hash instead, which splits over
       any number of tasks. The result is the same.

    Null counts as an empty text. Rows repeated in full each count as a
    place, so all of a text of `length` bytes or more goes from both. An empty table
    gives an empty result; other columns are ignored. Hashes have 64 bits.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    spans = repeated_spans(keyed.select("row", "text"), length, shard_bytes, most_fragments)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")).withColumnRenamed("row", "of")
    spans = stored(spans, "spans")
    squeeze = zstandard.ZstdCompressor

    def packed(batch):
        c = squeeze(3)
        return [batch.column("doc_id"), batch.column("row"), [c.compress(t) for t in texts(batch)]]

    types = {"doc_id": pa.int64(), "row": pa.int64(), "packed": pa.binary()}
    packs = keyed.mapInArrow(each(packed, types), "doc_id long, row long, packed binary")

    def remove(batch):
        grow, made = zstandard.ZstdDecompressor(), ([], [], [], [])
        for x, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = grow.decompress(x)
            gone = merged([(s["first"], s["last"]) for s in spans or ()])
            kept = b"".join(data[i:j] for i, j in zip([0, *(j for _, j in gone)], [*(i for i, _ in gone), len(data)], strict=True))
            v = (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest() if digests else kept)
            for column, y in zip(made, v, strict=True):
                column.append(y)
        return [batch.column("doc_id"), *made]

    kept, kind = ("kept_sha256", "string") if digests else ("kept", "binary")
    columns = dict.fromkeys(("doc_id", "n_bytes", "n_removed", "n_spans"), pa.int64()) | {kept: pa.string() if digests else pa.binary()}
    joined = packs.join(spans, F.expr("row = of"), "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(each(remove, columns), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept} {kind}")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digests=True)
