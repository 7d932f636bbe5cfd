"""Periodic runs: stretches of words that repeat with one period four times or more."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.llm.common import documents, texts

#: words of the texts that are worked on together; a longer text is worked on alone
BUNDLE = 1 << 17
#: a run has this many periods at least, and this many words
EXPONENT, LEAST = 4, 6
#: length of the smallest blocks; they serve the periods up to it
BLOCK = 4


# --- range successor: a wavelet tree in level order over a permutation ---


class WaveletTree:
    """The smallest value from x on among values[lo:hi], for many (lo, hi, x) at
    once. A level takes one bit a value, and a count for every 64 of them."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = values
        for bit in range(self.depth - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(len(now) - int(np.count_nonzero(ones)))
            now = np.r_[now[~ones], now[ones]]

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` values of a level have its bit."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(below)

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """-1 where no value of the range is as large as x."""
        first, last, less = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level in range(self.depth):
            a, b = self._ones(level, first), self._ones(level, last)
            right = (x >> (self.depth - 1 - level) & 1).astype(bool)
            less += np.where(right, (last - b) - (first - a), 0)
            first = np.where(right, self.zeros[level] + a, first - a)
            last = np.where(right, self.zeros[level] + b, last - b)
        less = np.where(x >> self.depth > 0, hi - lo, less)
        found = less < hi - lo
        first, last, nth, out = lo[found], hi[found], less[found], np.zeros(int(found.sum()), np.int64)
        for level in range(self.depth):
            a, b = self._ones(level, first), self._ones(level, last)
            left = (last - b) - (first - a)
            right = nth >= left
            nth = np.where(right, nth - left, nth)
            out = out << 1 | right
            first = np.where(right, self.zeros[level] + a, first - a)
            last = np.where(right, self.zeros[level] + b, last - b)
        result = np.full(len(lo), -1, np.int64)
        result[found] = out
        return result


# --- suffix array of the places whose first block occurs again ---


def numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def repeated_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose block of BLOCK words occurs twice or more, ascending, and
    a number for each block. A table of hash counts leaves most places out; what
    remains is compared word by word."""
    n = len(ids) - BLOCK + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(BLOCK):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    bits = n.bit_length() + 2
    cell = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)
    places = np.flatnonzero(np.bincount(cell, minlength=1 << bits)[cell] > 1)
    base = int(ids.max()) + 1
    pair = numbered(np.r_[ids[places] * base + ids[places + 1], ids[places + 2] * base + ids[places + 3]])
    name = numbered(pair[: len(places)] * len(pair) + pair[len(places) :])
    again = np.bincount(name)[name] > 1 if len(name) else np.zeros(0, bool)
    return places[again], numbered(name[again])


def suffixes(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """places, order, levels: the suffixes that start with a repeated block, their
    order (a suffix array, as indices of places), and for each block length b
    the range (lo, hi) of that array that holds the block at each place.

    Ranks are doubled: the order by blocks of b becomes that by blocks of 2 b,
    and only ranges of two or more are sorted again.
    """
    places, name = repeated_blocks(ids)
    k = len(places)
    index = np.full(len(ids) + 1, -1, np.int64)
    index[places] = np.arange(k)
    order = np.argsort(name, kind="stable")
    sizes = np.bincount(name)
    lo = (np.cumsum(sizes) - sizes)[name] if k else name
    hi = lo + sizes[name] if k else name
    levels, b = [(BLOCK, lo, hi)], BLOCK
    while b * 2 <= longest and (hi - lo > 1).any():
        slot = np.flatnonzero((hi - lo > 1)[order])
        open_ = order[slot]
        after = index[np.minimum(places[open_] + b, len(ids))]
        # a place that is not listed has a block that no other place has
        second = np.where(after >= 0, lo[after], k + open_)
        by = np.lexsort((second, lo[open_]))
        order[slot] = open_ = open_[by]
        second = second[by]
        new = np.r_[True, (lo[open_][1:] != lo[open_][:-1]) | (second[1:] != second[:-1])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(open_)])
        lo, hi = lo.copy(), hi.copy()
        lo[open_] = np.repeat(slot[start], size)
        hi[open_] = np.repeat(slot[start] + size, size)
        b *= 2
        levels.append((b, lo, hi))
    return places, order, levels


def candidates(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of stretches that repeat, each part of one run.

    Blocks of b words stand at every b/2 words. A run with b/2 < period <= b (any
    up to b for the smallest) and four periods holds one of them together with its
    next occurrence, at a distance of just one period: a block as long as the period
    occurs inside the run at whole periods only. So the next occurrence in the
    window of b words behind a block, if there is one, starts the only progression
    that matters, and its difference is a candidate. It is a period of the stretch
    from the block to its next occurrence's end, and the smallest one.
    """
    places, order, levels = suffixes(ids, longest)
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    tree = WaveletTree(order)
    starts, steps, blocks = [], [], []
    for b, lo, hi in levels:
        at = np.flatnonzero((hi - lo > 1) & (places % (b // 2) == 0))
        after = tree.successor(lo[at], hi[at], at + 1)
        at, after = at[after >= 0], after[after >= 0]
        step = places[after] - places[at]
        fits = (step <= b) & ((step > b // 2) | (b == BLOCK))
        starts.append(places[at[fits]])
        steps.append(step[fits])
        blocks.append(np.full(int(fits.sum()), b))
    start, step, block = map(np.concatenate, (starts, steps, blocks))
    by = np.lexsort((start, step))
    start, step, block = start[by], step[by], block[by]
    if not len(start):
        return start, start, step
    # blocks that follow each other within b share a period's length: one run
    new = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (start[1:] - start[:-1] > block[1:])])
    last = np.r_[new[1:], len(start)] - 1
    return start[new], start[last] + step[last] + block[last] - start[new], step[new]


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """Every run of the sequence as (start, length, period), by start, then period.

    A run is a stretch of EXPONENT periods and LEAST words at least, whose words
    one smallest period apart are identical, and that no neighbouring word
    extends. `longest` is the length of the longest part that words can repeat in.
    """
    found = set()
    for start, length, period in zip(*(x.tolist() for x in candidates(ids, longest // 2)), strict=True):
        lo, hi, span = start, start + length, max(16, period)
        while lo > 0:
            part = slice(max(0, lo - span), lo)
            other = np.flatnonzero(ids[part] != ids[part.start + period : lo + period])
            if len(other):
                lo = part.start + int(other[-1]) + 1
                break
            lo = part.start
        while hi < len(ids):
            part = slice(hi, min(len(ids), hi + span))
            other = np.flatnonzero(ids[part] != ids[hi - period : part.stop - period])
            if len(other):
                hi += int(other[0])
                break
            hi = part.stop
        if hi - lo >= max(LEAST, EXPONENT * period):
            found.add((lo, hi - lo, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


# --- the operator ---


def cycled(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query takes them: of one document in ten, chosen by the
    checksum of its id, the tail becomes a cycle of the tail's first words."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _bundles(batches: Iterator[pa.RecordBatch], altered) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, rows, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            words = text.split()  # of bytes: at ASCII white space
            ids.append(doc_id)
            rows.append(altered(words, doc_id) if altered else words)
            n += len(words)
            if n >= BUNDLE:
                yield ids, rows
                ids, rows, n = [], [], 0
    if ids:
        yield ids, rows


RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, altered=None) -> DataFrame:
    """doc_id, runs (start, length, period of each, by start, then period) and
    collapsed: the text's words without those that a run repeats, joined by blanks.

    Words are cut at ASCII white space and numbered from 0. A run is a stretch with a
    smallest period q and max(6, 4 q) words or more that no neighbouring word
    extends; runs may overlap, and a word goes when it stands in any run behind that
    run's first q words. `altered(words, doc_id)` may put other words in first.

    Internal pattern matching: the words of a text become numbers of that text's
    own, texts are laid end to end, and one suffix array serves a bundle of them
    (about BUNDLE words). Dyadic blocks ask it for their next occurrence in the
    window behind them (range successor in a wavelet tree); the differences are the
    candidate periods, and comparing words to both sides gives the whole run.
    Places whose first four words occur only once in their text are left out of the
    suffix array beforehand, as no run holds them and three more words.

    Map only, so that a lost task is run again by itself. Null, empty and blank texts
    have no runs and an empty collapsed text. A very long text is one bundle: some 200
    bytes a word are held for it, and time is n log n whatever its words repeat.
    Repeated rows are each reported, missing doc_ids too; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batches):
        for doc_ids, rows in _bundles(batches, altered):
            parts, base = [], 0
            for words in rows:
                known: dict[bytes, int] = {}
                parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
                base += len(known)
            ends = np.cumsum([len(x) for x in parts])
            found = find_runs(np.concatenate(parts), max(map(len, parts)))
            of = np.searchsorted(ends, [r[0] for r in found], "right").tolist()
            runs: list[list] = [[] for _ in rows]
            collapsed = [b" ".join(words) for words in rows] if not found else [None] * len(rows)
            for i, (start, length, period) in zip(of, found, strict=True):
                runs[i].append((start - int(ends[i]) + len(rows[i]), length, period))
            if found:
                for i, words in enumerate(rows):
                    if runs[i]:
                        stays = np.ones(len(words), bool)
                        for start, length, period in runs[i]:
                            stays[start + period : start + length] = False
                        words = [words[j] for j in np.flatnonzero(stays).tolist()]
                    collapsed[i] = b" ".join(words)
            each = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], pa.list_(each)),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {RUNS}, collapsed string")


#: the run with the greatest length / period, ties by start, then period: runs come in this order
BEST = """
aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (a, r) ->
    CASE WHEN a IS NULL OR CAST(r.length AS DECIMAL(38,0)) * a.period > CAST(a.length AS DECIMAL(38,0)) * r.period THEN r ELSE a END)
"""


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), cycled).selectExpr("doc_id", "runs", "collapsed", f"{BEST} AS best")
    return found.selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "best.*",
        "1000 * best.length DIV best.period AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


ORACLE = r"""
WITH summed AS (  -- CRC-32 of the id's digits, bit by bit
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda s, c: list_reduce(list_concat([xor(s, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) END AS h
  FROM documents),
shaped AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS cycled, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM summed),
worded AS (
  SELECT doc_id, n, CASE WHEN cycled THEN
           list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w
  FROM shaped),
placed AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM worded),
alike AS (  -- every pair of equal words at a distance that a run can have
  SELECT a.doc_id, a.i, b.i - a.i AS p FROM placed a JOIN placed b
    ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM alike),
stretches AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY doc_id, p, g HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretches GROUP BY doc_id, start, length),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS r FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
  WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1
LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
