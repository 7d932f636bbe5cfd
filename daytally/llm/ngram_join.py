"""N-gram Jaccard join: documents with nearly the same word shingles, by a grouped prefix join."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.llm.common import components, discard, documents, each, filter_of, in_filter, met_twice, stored, texts

#: ASCII white space to a blank, A-Z to a-z
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
BASE = np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"base": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, kept for the longest text so far."""
    if len(_powers["base"]) < n:
        for name, x in (("base", BASE), ("back", BACK)):
            _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(n + (n >> 1), x)])
    return _powers["base"][:n], _powers["back"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, ascending."""
    plain = b" ".join(text.translate(PLAIN).split())
    if not plain:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(plain, np.uint8)
    power, back = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    blanks = np.flatnonzero(data == 32)
    first, last = np.r_[0, blanks + 1], np.r_[blanks, len(data)]
    n = max(1, len(first) - width + 1)
    first, last = first[:n], last[-n:]
    return np.unique(mixed((sums[last] - sums[first]) * back[first]))


def overlap_needed(a, b, percent: int):
    """The least intersection of sets of sizes a and b that are linked: the
    smallest i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# --- how frequent shingles are: a count-min row, summed over all documents ---

#: cells of the row: one for about four words of text, and 2^25 at most (32 MB)
MOST_CELLS = 1 << 25
BYTES_PER_CELL = 24


def cells_for(docs: DataFrame, most: int = MOST_CELLS) -> int:
    """A power of two that follows the size of the texts, so that as many shingles meet in a
    cell by chance whatever the corpus, as far as `most` allows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(1 << 16, 1 << round(np.log2(max(1, size / BYTES_PER_CELL)))))


def frequencies(docs: DataFrame, width: int, cells: int, block: int = 1 << 15) -> np.ndarray:
    """How many documents have a shingle in each of `cells` hash cells, as 16 times the
    binary logarithm of one more than the count, in a byte.

    A task counts up to 255 in an array of the fixed size and sends it in compressed
    blocks; blocks are added up as they stream in, one small array at a time.
    """

    def count(batches):
        own = np.zeros(cells, np.uint8)
        for batch in batches:
            for t in texts(batch):
                at = (shingle_set(t, width) % np.uint64(cells)).astype(np.int64)
                own[at] += own[at] < 255
        squeeze = zstandard.ZstdCompressor(1)
        for i in range(0, cells, block):
            part = own[i : i + block]
            if part.any():
                yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int64()), "n": pa.array([squeeze.compress(part.tobytes())], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                part = np.frombuffer(grow.decompress(n), np.uint8)
                sums[i] = sums[i] + part if i in sums else part.astype(np.uint32)
        for i, x in sums.items():
            part = np.minimum(np.rint(16 * np.log2(1.0 + x)), 255).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int64()), "n": pa.array([part], pa.binary())})

    schema = "at long, n binary"
    got = docs.select("text").mapInArrow(count, schema).repartition("at").mapInArrow(add, schema).toArrow()
    out = np.zeros(cells, np.uint8)
    for i, n in zip(got.column("at").to_pylist(), got.column("n").to_pylist(), strict=True):
        out[i : i + block] = np.frombuffer(n, np.uint8)
    return out


def ordered(s: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The set in the order the prefixes are cut in: from rarer cells to more
    frequent ones, then by hash. A passage that documents share counts on top of
    what its cells hold by chance, so it comes late and leads to few candidates."""
    return s[np.lexsort((s, seen[(s % np.uint64(len(seen))).astype(np.int64)]))]


def _prepared(docs: DataFrame, width: int, percent: int, seen: np.ndarray) -> DataFrame:
    """A row per row of docs: its set's size and digest, its prefix and the prefix's
    digest (the group), and how frequent its shingles are on the whole."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def one(batch):
        seen, out = shared.value, ([], [], [], [], [])
        for t in texts(batch):
            s = shingle_set(t, width)
            n = len(s)
            if n:
                p = ordered(s, seen)[: n - -(-percent * n // 100) + 1]
                rank = float(seen[(s % np.uint64(len(seen))).astype(np.int64)].mean())
                row = (
                    n,
                    hashlib.md5(s.tobytes()).digest(),
                    int.from_bytes(hashlib.md5(n.to_bytes(8, "little") + p.tobytes()).digest()[:8], "little", signed=True),
                    rank,
                    p.view(np.int64),
                )
            else:
                row = (0, None, None, 0.0, np.zeros(0, np.int64))
            for column, v in zip(out, row, strict=True):
                column.append(v)
        return [batch.column("doc_id"), batch.column("row"), *out]

    columns = {
        "doc_id": pa.int64(), "row": pa.int64(), "n": pa.int64(), "sig": pa.binary(), "grp": pa.int64(), "rank": pa.float64(),
        "prefix": pa.list_(pa.int64()),
    }
    schema = "doc_id long, row long, n long, sig binary, grp long, rank double, prefix array<long>"
    return stored(docs.mapInArrow(each(one, columns), schema), "prefixes")


def _posts(rows: DataFrame) -> DataFrame:
    """token, at, grp, n, rank: where each prefix group has a token that another group has too."""
    exploded = rows.select(F.explode("prefix").alias("h"))
    shared = rows.sparkSession.sparkContext.broadcast(met_twice(exploded))

    def one(batch):
        bits = shared.value
        prefix = batch.column("prefix")
        tokens = np.ascontiguousarray(prefix.flatten().to_numpy())
        size = np.asarray(prefix.value_lengths())
        start = np.repeat(np.cumsum(size) - size, size)
        at, of = np.arange(len(tokens)) - start, np.repeat(np.arange(len(size)), size)
        keep = np.flatnonzero(in_filter(bits, tokens)) if len(tokens) else np.zeros(0, np.int64)
        of = pa.array(of[keep])
        return [pa.array(tokens[keep]), pa.array(at[keep]), *(batch.column(c).take(of) for c in ("grp", "n", "rank"))]

    columns = {"token": pa.int64(), "at": pa.int64(), "grp": pa.int64(), "n": pa.int64(), "rank": pa.float64()}
    posts = rows.select("prefix", "grp", "n", "rank").filter("grp IS NOT NULL")
    posts = posts.mapInArrow(each(one, columns), "token long, at long, grp long, n long, rank double")
    posts = stored(posts.groupBy("token", "at", "grp", "n").agg(F.max("rank").alias("rank")), "posts")
    met = posts.groupBy("token").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).filter("least <> most").select(F.col("token").alias("met"))
    met = stored(met, "met")
    shared_posts = stored(posts.join(met, F.expr("token = met")).drop("met"), "shared_posts")
    discard(posts, met)
    return shared_posts


#: may two sets with a token at these places of their orders overlap enough? Both
#: prefixes are cut for the sizes of the pair, so they are as short as these allow
FITS = "at < n - {o} + 1 AND pivot_at < pivot_n - {o} + 1 AND {o} <= least(n, pivot_n)"


def _fits(percent: int) -> str:
    return FITS.format(o=f"CAST(ceil({percent} * (n + pivot_n) / {100 + percent}) AS BIGINT)")


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set digests that are linked. Of the texts of docs (row, text) only
    those that some pair needs are packed and shuffled: a filter of their rows goes
    over the scan."""
    row_of = members.select("sig", "row")
    asked = pairs.join(row_of.selectExpr("sig AS a", "row AS row_a"), "a").join(row_of.selectExpr("sig AS b", "row AS row_b"), "b")
    asked = stored(asked, "asked")
    needed = filter_of(asked.selectExpr("row_a AS h").unionAll(asked.selectExpr("row_b AS h")))
    shared = docs.sparkSession.sparkContext.broadcast(needed)

    def pack(batch):
        rows = batch.column("row")
        at = np.flatnonzero(in_filter(shared.value, rows.to_numpy()))
        c = zstandard.ZstdCompressor(3)
        column = batch.column("text")
        return [rows.take(pa.array(at)), [c.compress((column[i].as_py() or "").encode()) for i in at.tolist()]]

    def one(batch):
        grow = zstandard.ZstdDecompressor()
        known, a, b = {}, batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for i, (x, y, s, t) in enumerate(zip(a, b, batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)):
            if y not in known:
                known = {y: shingle_set(grow.decompress(t), width)}  # the pairs of a pivot come one after another
            if linked(shingle_set(grow.decompress(s), width), known[y], percent):
                keep.append(i)
        keep = pa.array(keep, pa.int32())
        return [batch.column("a").take(keep), batch.column("b").take(keep)]

    packs = docs.select("row", "text").mapInArrow(each(pack, {"at_row": pa.int64(), "packed": pa.binary()}), "at_row long, packed binary")
    packs = packs.groupBy("at_row").agg(F.first("packed").alias("packed"))  # rows that are repeated in full
    read = asked.join(packs.selectExpr("at_row AS row_a", "packed AS s"), "row_a")
    read = read.join(packs.selectExpr("at_row AS row_b", "packed AS t"), "row_b").select("a", "b", "s", "t")
    made = stored(read.mapInArrow(each(one, {"a": pa.binary(), "b": pa.binary()}), "a binary, b binary"), "verified")
    discard(asked)
    return made


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, cells: int | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id, part, one row per row of docs; part is
    the component's own key, null for an empty set.

    A document's set holds its distinct shingles of `width` words (white-space
    words, A-Z lower-cased), or its whole sequence where it has fewer. Two
    documents are linked when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach.

    Grouped prefix join: each set is ordered alike everywhere, rarer shingles
    before frequent ones, and two linked sets share one in their first few. All
    documents with one prefix and size are one group; groups are joined on tokens,
    the pairs are filtered by size and place, expanded to sets and verified on the
    texts. Equal sets are one from the start.

    Pairs within a token's group are never all formed. First stars: each group
    against the one whose shingles are most frequent, which in a family of
    copies is the original. Then what the stars left in different components
    is joined, however much that is, so no link between components is missed.
    Links are not returned, and those inside a component that stars have made are not
    all looked for: neither pairs nor a document's number of links can be had.

    Null, empty or blank text has an empty set, linked with nothing, and its own
    doc_id as component. Missing doc_ids do not count as the smallest; rows
    repeated in full share all results. An empty table gives an empty result;
    other columns are ignored. Texts are hashed to 64 bits a shingle.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    seen = frequencies(keyed, width, cells or cells_for(keyed))
    rows = _prepared(keyed, width, percent, seen)
    sigs = rows.filter("sig IS NOT NULL").groupBy("sig").agg(
        F.min(F.struct("grp", "n", "rank", "row")).alias("x"), F.min("doc_id").alias("least_id")
    )
    sigs = stored(sigs.select("sig", "x.*", "least_id"), "sets")
    posts = _posts(rows)

    # all sets that can take part: of groups with a shared token, or with several sets
    several = sigs.groupBy("grp").agg(F.count("*").alias("k")).filter("k > 1").select("grp")
    open_groups = stored(posts.select("grp").unionAll(several).distinct().withColumnRenamed("grp", "g"), "open_groups")
    members = stored(sigs.join(open_groups, F.expr("grp = g")).select("grp", "n", "rank", "sig", "row"), "members")
    discard(open_groups)

    # round 1: stars. In a group the set with the most frequent shingles stands for
    # it; on a token the group whose stand-in has the most frequent shingles.
    lead = members.groupBy("grp").agg(F.max(F.struct("rank", "sig")).alias("lead"))
    lead = stored(lead.selectExpr("grp AS g", "lead.sig AS lead"), "leads")
    within = members.join(lead, F.expr("grp = g AND sig <> lead")).selectExpr("sig AS a", "lead AS b")
    pivot = posts.groupBy("token").agg(F.max(F.struct("rank", "grp", "n", "at")).alias("p"))
    pivot = stored(pivot.selectExpr("token AS t", "p.grp AS pivot", "p.n AS pivot_n", "p.at AS pivot_at"), "pivots")
    star = posts.join(pivot, F.expr(f"token = t AND grp <> pivot AND {_fits(percent)}")).select("grp", "pivot").distinct()
    star = star.join(lead.selectExpr("g", "lead AS a"), F.expr("grp = g")).select("a", "pivot")
    star = star.join(lead.selectExpr("g", "lead AS b"), F.expr("pivot = g")).select("a", "b")
    first = stored(within.unionAll(star).distinct(), "stars")
    discard(lead, pivot)
    links = _verified(first, members, keyed, width, percent)
    discard(first)

    # round 2: whatever the stars left apart. On a token, the groups outside the
    # pivot's component meet all groups of other components; the same within a group.
    parts = stored(components(links), "parts")
    parted = members.join(parts, F.expr("sig = node"), "left").select("grp", "n", "sig", F.coalesce("component", "sig").alias("part"))
    parted = stored(parted, "parted")
    cells_of = stored(parted.select("grp", "part").distinct().withColumnsRenamed({"grp": "g"}), "cells")
    spread = stored(posts.drop("rank").join(cells_of, F.expr("grp = g")).drop("g"), "spread")
    discard(posts, cells_of)
    # the part with the most groups on a token is its main one
    ranked = spread.groupBy("token", "part").agg(F.count("*").alias("k"))
    top = ranked.groupBy("token").agg(F.max(F.struct("k", "part")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    top = stored(top.selectExpr("token AS t", "m.part AS main"), "mains")
    mixed_posts = stored(spread.join(top, F.expr("token = t")).drop("t"), "mixed")
    discard(spread, top)
    few = mixed_posts.filter("part <> main")
    other = mixed_posts.selectExpr("token AS t", "grp AS pivot", "n AS pivot_n", "at AS pivot_at", "part AS pivot_part", "main AS pivot_main")
    across = few.join(other, F.expr(f"token = t AND part <> pivot_part AND {_fits(percent)}")).filter(
        "pivot_part = pivot_main OR part < pivot_part"
    )
    across = across.select("grp", "part", "pivot", "pivot_part").distinct()
    own = parted.selectExpr("grp AS g1", "part AS p1", "sig AS a")
    its = parted.selectExpr("grp AS g2", "part AS p2", "sig AS b")
    rest = across.join(own, F.expr("grp = g1 AND part = p1")).join(its, F.expr("pivot = g2 AND pivot_part = p2")).select("a", "b")
    inside = parted.groupBy("grp", "part").agg(F.count("*").alias("k")).groupBy("grp")
    inside = inside.agg(F.max(F.struct("k", "part")).alias("m"), F.count("*").alias("parts")).filter("parts > 1").selectExpr("grp AS g", "m.part AS main")
    torn = stored(parted.join(stored(inside, "torn_mains"), F.expr("grp = g")).select("grp", "sig", "part", "main"), "torn")
    inner = torn.filter("part <> main").selectExpr("grp AS g", "sig AS a", "part AS p").join(torn, F.expr("g = grp AND p <> part"))
    inner = inner.filter("part = main OR p < part").selectExpr("a", "sig AS b")
    second = stored(rest.unionAll(inner).selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "rest")
    discard(mixed_posts, parted, torn)
    more = _verified(second, members, keyed, width, percent)
    discard(second, members)
    parts = stored(components(links.unionAll(more)), "components")
    discard(links, more)

    known = sigs.join(parts, F.expr("sig = node"), "left").select("sig", F.coalesce("component", "sig").alias("part"), "least_id")
    known = stored(known, "known")
    named = stored(known.groupBy("part").agg(F.min("least_id").alias("component_id")).withColumnRenamed("part", "p"), "named")
    known = stored(known.join(named, F.expr("part = p")).select(F.col("sig").alias("of"), "component_id", "part"), "ids")
    discard(sigs, parts, named)
    joined = rows.select("doc_id", "row", "n", "sig").join(known, F.expr("sig = of"), "left")
    return joined.select(
        "doc_id",
        "row",
        F.col("n").alias("n_shingles"),
        F.expr("CASE WHEN sig IS NULL THEN doc_id ELSE component_id END AS component_id"),
        "part",
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the smallest doc_id stays (a
    missing one only where there is no other), once. Documents without words stay. Of
    rows with one doc_id and text the smallest by its other columns stays, so reruns
    agree. A row goes only when its component keeps another one: rows that stay are
    found by hash and doc_id, and told apart by 128 bits of their text."""
    found = stored(near_duplicates(docs, width, percent), "near")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("best")
    stay = found.filter("part IS NOT NULL").groupBy("part").agg(best).select("best.doc_id", "best.row")
    stay = stored(stay.unionAll(found.filter("part IS NULL").select("doc_id", "row")).distinct(), "stay")
    discard(found)
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(F.xxhash64(doc_id, "text").alias("at_row"), doc_id.alias("at_id"), F.md5("text").alias("digest"), F.struct(*docs.columns).alias("whole"))
    left = keyed.join(stay, F.expr("at_row = row AND at_id <=> doc_id"), "left_semi")
    return left.groupBy("at_row", "at_id", "digest").agg(F.min("whole").alias("whole")).select("whole.*")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
placed AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM worded WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
