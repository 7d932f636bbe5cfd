"""The pipeline's stages, each against a plain version on its own input."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from brute import WORD, fold, key, lines, near, sha

from daytally.llm import bpe, entries, langid, mixing
from daytally.llm.common import stored

PARTS = {"en": "the of and ing tion er ly wh th sh".split(), "de": "der und sch ung keit ein über ß tz".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, rejected int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)

    def text(lang, n):
        return " ".join("".join(rng.choices(PARTS[lang], k=2)) for _ in range(n))

    rows = [(1, None), (2, ""), (3, "12 34"), (4, "word"), (None, text("en", 30))]
    for d in range(10, 60):
        lang = rng.choice(list(PARTS))
        rows.append((d, "\n".join(text(lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 3)))))
    for d in range(60, 90):  # whole and near copies, and repeated lines among own ones
        kind, old = d % 3, rng.choice(rows[5:50])[1]
        near_copy = " ".join(w if rng.random() > 0.02 else "neu" for w in old.split())
        rows.append((d, [old, near_copy, old.split("\n")[0] + "\n" + text("en", 25)][kind]))
    rows.append(rows[-1])
    full = [(d, t, None if i % 9 == 0 else "en" if i % 2 else "de", f"s{i % 4}" if i % 5 else None, 0, "x", 1) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (key(r[0]), r[1] or ""))


def test_stages(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_join", "mixing", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    made = {"start": stored(docs, "start")}
    before = "start"
    for name in names:
        made[name] = stored(stages[name](spark, made[before], ""), name)
        if name != "bpe":
            assert made[name].columns == docs.columns
        before = name

    start, told = pairs(made["start"]), pairs(made["language_id"])
    assert told == [r for r in start if r[1] and any(map(str.isalpha, r[1]))]

    rows = list(dict.fromkeys(told))  # a row repeated in full is one document
    left = lines(rows, 20)
    kept = {d: left[d] for d, t in rows if left[d] == t or WORD.search(left[d])}
    assert pairs(made["line_dedup"]) == [(d, kept[d]) for d, _ in told if d in kept]

    components = {d: c for d, _, c in near(sorted(kept.items(), key=lambda r: key(r[0])))}
    stay = [(d, kept[d]) for d in sorted(kept, key=key) if components[d] == d]
    assert pairs(made["ngram_join"]) == stay

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(made["ngram_join"]).collect()}
    assert Counter(d for d, _ in pairs(made["mixing"])) == +Counter(copies)

    library = bpe.ByteBpe(bpe.public_vocabulary())
    encoded = made["bpe"].collect()
    assert Counter(r["doc_id"] for r in encoded) == +Counter(copies)
    for r in encoded:
        assert library.decode(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == kept[r["doc_id"]]
        assert r["decoded_sha256"] == sha(kept[r["doc_id"]])


def test_run_equals_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "n_tokens" in out.columns and out.count() > 30


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = [r for r in langid.identify(docs, f"NOT {langid.FOLD}").collect() if fold(r["doc_id"], 4)]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.97 * len(found)


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in entries.QUERIES) == list(range(1, 14))
    assert set(entries.SQL) <= set(entries.QUERIES)


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_query_matches_its_sql(name, spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(entries.SQL[name])
    columns = [d[0] for d in cursor.description]
    df = entries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got == sorted(cursor.fetchall(), key=repr)
