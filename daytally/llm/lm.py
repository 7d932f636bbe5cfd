"""LM scoring: a smoothed bigram model as a weighted automaton with failure arcs."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.llm.common import documents, stored
from daytally.llm.ngram_join import PLAIN, mixed

#: the token after the last word; no word holds a blank
END = b" "


# --- chunks: runs of documents that are scored together ---


def chunked(docs: DataFrame, learned_from: str, chunk_bytes: int) -> DataFrame:
    """chunk, ids, learn, ends, packed: a row per run of documents of about
    chunk_bytes; packed holds their texts one after another, compressed."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, learn, own, size = [], [], [], 0

        def row():
            ends = np.cumsum([len(t) for t in own])
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([(part << 24) + n], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "learn": pa.array([learn], pa.list_(pa.bool_())),
                    "ends": pa.array([ends.tolist()], pa.list_(pa.int64())),
                    "packed": pa.array([zstandard.ZstdCompressor(3).compress(b"".join(own))], pa.binary()),
                }
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "learn", "text")), strict=True)
            for d, x, t in rows:
                t = (t or "").encode()
                ids.append(d), learn.append(x), own.append(t)
                size += len(t) + 16
                if size >= chunk_bytes:
                    yield row()
                    n, size = n + 1, 0
                    ids, learn, own = [], [], []
        if own:
            yield row()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(f"({learned_from})").alias("learn"), "text")
    schema = "chunk long, ids array<long>, learn array<boolean>, ends array<long>, packed binary"
    return stored(keyed.mapInArrow(run, schema), "chunks")


class Chunk:
    """The documents of a chunk as numbers of the chunk's own words, END last."""

    def __init__(self, table: pa.Table):
        row = table.slice(0, 1)
        self.ids = row.column("ids")[0].as_py()
        self.learn = row.column("learn")[0].as_py()
        data = zstandard.ZstdDecompressor().decompress(row.column("packed")[0].as_py()).translate(PLAIN)
        number: dict[bytes, int] = {}
        self.docs, start = [], 0
        for end in row.column("ends")[0].as_py():
            self.docs.append(array("q", [number.setdefault(w, len(number)) for w in [*data[start:end].split(), END]]))
            start = end
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        self.keys, self.number = keys, number

    def learned(self) -> list[array]:
        return [d for d, yes in zip(self.docs, self.learn, strict=True) if yes]

    def counts(self) -> np.ndarray:
        out = np.zeros(len(self.keys), np.int64)
        for d in self.learned():
            np.add.at(out, np.frombuffer(d, np.int64), 1)
        return out

    def pairs(self, docs: list[array]) -> np.ndarray:
        """Every pair of neighbours as first * words + second."""
        n = np.int64(len(self.keys))
        parts = [(x := np.frombuffer(d, np.int64))[:-1] * n + x[1:] for d in docs if len(d) > 1]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


# --- counts over all chunks: each chunk asks for the keys it has, and is answered in their order ---


def asked(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """A row per bucket with the chunk's keys and own counts; the order of the keys in the rows."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    bucket = (keys >> np.uint64(40)).astype(np.int64) * buckets >> 24
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    squeeze = zstandard.ZstdCompressor(1)
    rows = {"bucket": [], "chunk": [], "keys": [], "counts": []}
    for b in range(buckets):
        i, j = cut[b], cut[b + 1]
        if i < j:
            steps = np.diff(keys[i:j], prepend=np.uint64(0))
            rows["bucket"].append(b), rows["chunk"].append(chunk)
            rows["keys"].append(squeeze.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()))
            rows["counts"].append(squeeze.compress(counts[i:j].astype(np.uint64).tobytes()))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(rows.items(), types, strict=True)}), order


ASKED = "bucket long, chunk long, keys binary, counts binary"
ANSWERED = "chunk long, bucket long, counts binary, distinct long, total long"


def answer(table: pa.Table) -> pa.Table:
    """Sum the counts of a bucket over all chunks; a row per chunk that asked, with
    twice the sum for each of its keys, and one more where other chunks asked too."""
    grow, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)

    def keys_of(x: bytes) -> np.ndarray:
        return np.cumsum(np.ascontiguousarray(np.frombuffer(grow.decompress(x), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)

    keys = [keys_of(x) for x in table.column("keys").to_pylist()]
    own = [np.frombuffer(grow.decompress(x), np.uint64) for x in table.column("counts").to_pylist()]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(known), np.uint64)
    np.add.at(total, at, np.concatenate(own))
    coded = total * np.uint64(2) + (np.bincount(at, minlength=len(known)) > 1)
    made, start = [], 0
    for k in keys:
        made.append(squeeze.compress(coded[at[start : start + len(k)]].tobytes()))
        start += len(k)
    n = len(made)
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "bucket": table.column("bucket"),
            "counts": pa.array(made, pa.binary()),
            "distinct": pa.array([int((total > 0).sum())] * n, pa.int64()),
            "total": pa.array([int(total.sum())] * n, pa.int64()),
        }
    )


def answers(table: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and whether other chunks asked too, in the order the keys had before they were sorted."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("counts").to_pylist(), strict=True))
    grow = zstandard.ZstdDecompressor()
    out = np.zeros(len(order), np.int64)
    if rows:
        out[order] = np.concatenate([np.frombuffer(grow.decompress(x), np.uint64) for _, x in rows]).astype(np.int64)
    return out >> 1, (out & 1).astype(bool)


def open_pairs(chunk: Chunk, counts: np.ndarray, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, their counts in the chunk's own learned documents, which of
    them other chunks may have too, and the keys of these.

    Of a pair with a word that no other chunk has, the own count is the whole; a
    pair with a word that is never learned is never learned.
    """
    n = len(chunk.keys)
    pairs = np.unique(chunk.pairs(chunk.docs))
    own = np.zeros(len(pairs), np.int64)
    np.add.at(own, np.searchsorted(pairs, chunk.pairs(chunk.learned())), 1)
    first, second = pairs // n, pairs % n
    open_words = elsewhere & (counts > 0)
    several = np.flatnonzero(open_words[first] & open_words[second])
    keys = mixed(mixed(chunk.keys[first[several]]) * np.uint64(0x9E3779B97F4A7C15) + chunk.keys[second[several]])
    return pairs, own, several, keys


# --- the automaton ---


class Automaton:
    """States are the empty context and every word; an arc of a word state is a
    bigram, and its failure arc leads to the empty context at the weight of
    backing off. Weights are log10 probabilities, smoothed towards the
    unigram: p(w | h) = (c(h w) + mu p(w)) / (c(h) + mu).
    """

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int, distinct: int, mu: float):
        n = len(counts)
        unigram = (counts + 1.0) / (total + distinct + 1)
        seen = pair_counts > 0
        pairs, pair_counts = pairs[seen], pair_counts[seen]
        first, second = pairs // n, pairs % n
        weights = np.log10((pair_counts + mu * unigram[second]) / (counts[first] + mu))
        self.words = n
        self.arcs = dict(zip(pairs.tolist(), weights.tolist(), strict=True))
        self.root = np.log10(unigram).tolist()
        self.fail = np.log10(mu / (counts + mu)).tolist()

    def score(self, tokens: array) -> float:
        arcs, root, fail, n = self.arcs.get, self.root, self.fail, self.words
        state, total = -1, 0.0
        for w in tokens:
            weight = arcs(state * n + w) if state >= 0 else None
            if weight is None:
                if state >= 0:
                    total += fail[state]
                weight = root[w]
            total += weight
            state = w
        return total


def score_documents(docs: DataFrame, learned_from: str, mu: float = 100.0, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model is learned from all rows the SQL condition names (null counts as
    no), with no cut-off: every word and every pair of neighbours is counted.
    The documents are cut into chunks of a bounded size. For words, then for pairs,
    each chunk asks buckets of hashed keys for the counts of what it holds and is
    answered in that order; a chunk's answers are the part of the automaton that
    its texts can reach, and one traversal scores each of them. Nothing is
    broadcast. A word or pair is one key a chunk, however frequent it is, so
    buckets are even.

    Tokens are white-space words, A-Z lower-cased, and one end. Null text counts as
    empty, its only token the end. Where nothing is learned, train_tokens is 0
    and all probabilities are 1. Repeated rows are each scored and each
    learned from; an empty table gives an empty result; other columns are ignored.
    Keys are 64-bit hashes of the words.
    """
    chunks = chunked(docs, f"coalesce({learned_from}, false)", chunk_bytes)
    n = chunks.count()
    buckets = max(1, min(n, 64), n // 4)  # a bucket holds the keys of about four chunks

    def ask_words(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(i, 1)])
                chunk = Chunk(table)
                yield asked(table.column("chunk")[0].as_py(), chunk.keys, chunk.counts(), buckets)[0]

    words = chunks.mapInArrow(ask_words, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED)
    words = stored(words, "words")
    totals = words.groupBy("bucket").agg(F.max("distinct").alias("v"), F.max("total").alias("n"))
    total, distinct = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def ask_pairs(table: pa.Table, got: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        _, own, several, keys = open_pairs(chunk, *answers(got, np.argsort(chunk.keys)))
        return pa.Table.from_batches([asked(table.column("chunk")[0].as_py(), keys, own[several], buckets)[0]])

    pairs = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(ask_pairs, ASKED)
    pairs = stored(pairs.groupBy("bucket").applyInArrow(answer, ANSWERED), "pairs")
    got = words.withColumn("kind", F.lit(1)).unionAll(pairs.withColumn("kind", F.lit(2)))

    def score(table: pa.Table, got: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        kind = np.asarray(got.column("kind").to_numpy())
        counts, elsewhere = answers(got.filter(pa.array(kind == 1)), np.argsort(chunk.keys))
        held, own, several, keys = open_pairs(chunk, counts, elsewhere)
        own[several] = answers(got.filter(pa.array(kind == 2)), np.argsort(keys))[0]
        automaton = Automaton(counts, held, own, total, distinct, mu)
        base = np.log10((counts + 1) / (total + distinct + 1))
        tokens = [np.frombuffer(d, np.int64) for d in chunk.docs]
        return pa.table(
            {
                "doc_id": pa.array(chunk.ids, pa.int64()),
                "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
                "n_known": pa.array([int((counts[t] > 0).sum()) for t in tokens], pa.int64()),
                "train_tokens": pa.array([total] * len(tokens), pa.int64()),
                "base_score": pa.array([math.fsum(base[t]) for t in tokens], pa.float64()),
                "score": pa.array([automaton.score(d) for d in chunk.docs], pa.float64()),
            }
        )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(score, schema)


#: the fold that is held out when measuring
FOLD = "coalesce(crc32(CAST(doc_id AS STRING)) % 7 = 2, false)"


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(documents(spark, sf_dir), f"NOT {FOLD}")
    return scored.selectExpr("doc_id", f"{FOLD} AS held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
