"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytally.llm.common import begun, documents, each, released, stored

#: what a text without a letter, or no text, is said to be written in
NONE = "und"
#: ASCII other than letters to blanks; digits and signs say nothing of a language
LETTERS = np.array([b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], "uint32")


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (2, 3)
    dims: int = 1 << 14
    #: documents a language is learned from, at most; the rows are the ones with the smallest hashes
    per_language: int = 300
    centroids: int = 3
    #: a text is rejected below this share of the cosine that `quantile` of the
    #: language's held-out pieces of its size stay under
    quantile: float = 0.02
    slack: float = 0.5
    #: parts of the sample that are held out in turn to measure these cosines
    parts: int = 4
    seed: int = 0


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)  # of each centroid
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None  # one row each, of length 1
    least: np.ndarray | None = None  # the smallest cosine that is not rejected, a row per centroid, a column per size


def ngram_counts(text: str, s: Settings) -> np.ndarray:
    """How often each hashed n-gram of bytes occurs in the whole text."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    b = LETTERS[data]
    if len(b):
        b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]  # runs of blanks are one
    b = np.r_[np.uint32(32), b, np.uint32(32)].astype(np.uint32)
    counts = np.zeros(s.dims, np.int64)
    shift = np.uint32(32 - (s.dims.bit_length() - 1))
    key = np.zeros(len(b), np.uint32)
    for n in range(1, max(s.orders) + 1):
        key = key[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] if n > 1 else b + np.uint32(1)
        if n in s.orders and len(key):
            counts += np.bincount((key * np.uint32(2654435761 + 2 * n)) >> shift, minlength=s.dims)
    return counts


def pieces(text: str) -> list[str]:
    """The text, then from its middle 1, 2, 4, ... code points, as far as it goes."""
    lengths = [1 << i for i in range(len(text).bit_length()) if 1 << i < len(text)]
    return [text, *[p for n in lengths if has_letter(p := text[(len(text) - n) // 2 :][:n])]]


def sizes(counts: np.ndarray) -> np.ndarray:
    """Of each row the number of different n-grams, in powers of two."""
    return np.frexp((counts > 0).sum(axis=1))[1]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF times IDF, each row of length 1."""
    v = np.log1p(counts).astype(np.float32) * idf
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def clustered(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, the next ones the rows furthest away."""
    k = min(k, len(v))
    centres = [v.mean(axis=0)]
    while len(centres) < k:
        near = (v @ np.array(centres).T).max(axis=1)
        centres.append(v[rng.choice(np.flatnonzero(near <= np.quantile(near, 0.25)))])
    c = np.array(centres)
    for _ in range(10):
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-9)
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-9)


def cutoffs(near: np.ndarray, size: np.ndarray, s: Settings) -> np.ndarray:
    """For every size the cosine under which a text is rejected, from the cosines
    `near` of held-out pieces of these sizes. A size without a piece takes the
    next smaller one's; a larger size never has a lower cut-off than a smaller one.
    """
    cut = np.full(s.dims.bit_length() + 1, np.nan)
    for k in np.unique(size):
        cut[k] = s.slack * np.quantile(near[size == k], s.quantile)
    known = np.flatnonzero(~np.isnan(cut))
    if not len(known):
        return np.zeros(len(cut))
    cut[known] = np.minimum.accumulate(cut[known][::-1])[::-1]
    return cut[known[np.maximum(np.searchsorted(known, np.arange(len(cut)), "right") - 1, 0)]]


def pieces_of(column: pa.ChunkedArray) -> list[list[np.ndarray]]:
    """Lists of lists as views of one array of numbers, at four bytes each."""
    out = []
    for chunk in column.chunks:
        inner = chunk.flatten()
        flat, ends = inner.flatten().to_numpy(), np.cumsum(np.r_[0, np.asarray(inner.value_lengths())])
        outer = np.cumsum(np.r_[0, np.asarray(chunk.value_lengths())]).tolist()
        out += [[flat[ends[k] : ends[k + 1]] for k in range(lo, hi)] for lo, hi in zip(outer, outer[1:])]
    return out


def learn(docs: DataFrame, learned_from: str, s: Settings = Settings()) -> Model:
    """Fit on a bounded sample: of the rows the SQL condition names, those with a
    language, and of each language at most s.per_language documents with a letter.

    The sample is drawn in two steps, first within 64 parts of a language, so
    that a hot one is ranked by many tasks. What the driver gets is bounded by
    s.per_language times the number of languages: the n-gram counts of these
    documents and of their pieces, sparse. A piece has s.dims different n-grams at
    most, and so a document of any length takes some 20 * s.dims * 8 bytes at the worst.

    Cut-offs come from documents that were not learned from: each of s.parts parts
    of a language's sample is held against centroids of the other parts, as
    whole documents and in pieces of every length, since the cosine of a text grows
    with the number of its n-grams. A language with one document has no cut-off.
    """
    rows = docs.filter(f"({learned_from}) AND lang IS NOT NULL AND text RLIKE '\\\\p{{L}}'").select(
        "doc_id", F.col("lang").alias("language"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(s.seed)).alias("draw")
    )
    part = Window.partitionBy("language", F.pmod("draw", F.lit(64))).orderBy("draw", "doc_id")
    whole = Window.partitionBy("language").orderBy("draw", "doc_id")
    drawn = rows.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= s.per_language)
    drawn = drawn.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= s.per_language)
    drawn = stored(drawn.select(F.col("doc_id").alias("drawn_id"), "language").distinct(), "sample")

    def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = ngram_counts(text, s)  # dense ones of a whole batch would not fit
        at = np.flatnonzero(counts)
        return at, counts[at]

    def one(batch):
        found = [[sparse(p) for p in pieces(t)] for t in batch.column("text").to_pylist()]
        return [batch.column("language"), *([[piece[k] for piece in x] for x in found] for k in (0, 1))]

    lists = pa.list_(pa.list_(pa.int32()))
    types = {"language": pa.string(), "at": lists, "n": lists}
    sampled = docs.select("doc_id", "lang", "text").filter("text IS NOT NULL")
    sampled = sampled.join(F.broadcast(drawn), F.expr("doc_id = drawn_id AND lang = language"))
    made = sampled.select("language", "text").mapInArrow(each(one, types), "language string, at array<array<int>>, n array<array<int>>")
    got = made.toArrow()
    names = got.column("language").to_pylist()
    ats, ns = (pieces_of(got.column(c)) for c in ("at", "n"))
    first = [(at[0].astype(">u4").tobytes(), n[0].astype(">u4").tobytes()) for at, n in zip(ats, ns, strict=True)]
    order = sorted(range(len(names)), key=lambda i: (names[i], first[i]))
    df = np.zeros(s.dims)
    for at in ats:
        df[at[0]] += 1
    model = Model(idf=(np.log((len(names) + 1) / (df + 1)) + 1).astype(np.float32))

    def dense(i: int, some: slice) -> np.ndarray:
        counts = np.zeros((len(ats[i][some]), s.dims), np.float32)
        for row, (at, n) in enumerate(zip(ats[i][some], ns[i][some], strict=True)):
            counts[row, at] = n
        return counts

    centroids, least = [], []
    for name in sorted(set(names)):
        own = [i for i in order if names[i] == name]
        v = vectors(np.concatenate([dense(i, slice(1)) for i in own]), model.idf)
        c = clustered(v, s.centroids, np.random.default_rng(s.seed))
        # copies stay in one part, or a document would be held against itself
        text = np.cumsum([0, *[first[i] != first[j] for j, i in zip(own, own[1:])]])
        near, size = [], []
        for part in range(s.parts):
            out = text % s.parts == part
            if out.any() and not out.all():
                others = clustered(v[~out], s.centroids, np.random.default_rng(s.seed))
                for i in np.flatnonzero(out):
                    counts = dense(own[i], slice(None))
                    near.append((vectors(counts, model.idf) @ others.T).max(axis=1))
                    size.append(sizes(counts))
        cut = cutoffs(np.concatenate(near or [np.zeros(0)]), np.concatenate(size or [np.zeros(0, int)]), s)
        for k in range(len(c)):
            model.languages.append(name)
            centroids.append(c[k])
            least.append(cut)
    model.centroids = np.array(centroids, np.float32) if centroids else np.zeros((0, s.dims), np.float32)
    model.least = np.array(least, np.float32)
    return model


#: texts that are scored at once
SLICE = 64


def identify(docs: DataFrame, learned_from: str, s: Settings = Settings(), whole: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected and the column `whole`, if there is to be one: a
    struct with all columns of a document, its text among them.

    The text alone decides: its hashed n-grams, as a TF-IDF vector, are compared
    with the centroids by cosine; the nearest one names the language and its
    cosine is the score. `rejected` says that the text has no letter, or lies
    further from the centroid it is nearest to than held-out documents of that
    language do at this number of n-grams (`learn`). Of a text of a word or two
    there is little to tell, and its cut-off is as low as theirs.

    Null text, or one without a letter, gives `und`, score 0 and rejected; so does
    every text when there is nothing to learn from. Whole texts are used, however
    long; ties go to the first language by name. Repeated rows are each reported,
    an empty table gives an empty result, and other columns are ignored.
    """
    model = learn(docs, learned_from, s)
    kept = ["doc_id"] if whole is None else ["doc_id", whole]
    schema = docs.select(*kept).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most s.centroids rows of s.dims numbers a language

    def scored(texts: list[str | None]) -> tuple[list, list, list]:
        model = shared.value
        name, score, out = [NONE] * len(texts), [0.0] * len(texts), [True] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
        if at and len(model.languages):
            v = np.stack([np.log1p(ngram_counts(texts[i], s)).astype(np.float32) for i in at])
            size = sizes(v)
            v *= model.idf
            v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], np.float32(1e-30))
            near = v @ model.centroids.T
            best = near.argmax(axis=1)
            least = model.least[best, size].tolist()
            for i, k, x, low in zip(at, best.tolist(), near.max(axis=1).tolist(), least, strict=True):
                name[i], score[i], out[i] = model.languages[k], min(1.0, max(0.0, x)), x < low
        return name, score, out

    def run(batches):
        begun()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                text = part.column("text") if whole is None else part.column(whole).field("text")
                name, score, out = scored(text.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                    [*kept, "lang_pred", "score", "rejected"],
                )
        released()

    out = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*kept, *(["text"] if whole is None else [])).mapInArrow(run, out)


#: the fold that is held out when measuring, and the rows that are learned from
FOLD = "coalesce(crc32(CAST(doc_id AS STRING)) % 4 = 2, false)"


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir), f"NOT {FOLD}")
    return found.selectExpr("doc_id", f"{FOLD} AS held_out", "lang_pred", "score", "rejected")
