"""Each text operator against a plain version, on rows that are easy to get wrong."""

import random
from pathlib import Path

import pytest
from brute import (
    exact,
    fold,
    key,
    licenses,
    lines,
    lm as plain_lm,
    near,
    quality as plain_quality,
    repeats,
    sha,
    targets,
)

from daytally.llm import bpe, exact_dedup, langid, licenses as scan, line_dedup, lm, mixing, ngram_join, quality, substring_dedup

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside or return
    "row long, h binary, n int, size string, score string, rejected int, key double, words string, of int, id int, language string, "
    "kept int, part int, copies string, n_lines string, component_id string, bits int, word int, token int, chunk int"
)
EXTRA = (7, b"x", 1, "s", "sc", 0, 1.5, "w", 1, 2, "la", 3, 4, "c", "nl", "ci", 1, 2, 3, 4)


def table(spark, rows):
    """rows: doc_id, text[, lang[, source]]"""
    full = []
    for r in rows:
        text, lang, source = r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1"
        full.append((r[0], text, lang, source, None if text is None else len(text), *EXTRA))
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(rng, n, words=None):
    words = words or ["the", "Of", "and", "über", "señor", "tion", "x1", "re-do", "l’eau", "don't", "#tag", "日本"]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, blanks, one very long text, near and exact copies, repeated lines."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(15, 60), [f"w{i}" for i in range(200)]) for _ in range(5)]
    made = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "a"), (5, "a b"), (6, "A\tB"), (7, "word " * 9), (8, "y" * 5000), (9, "ab " * 20000)]
    made += [(10, "Released under the MIT License.\nMIT  license, General Public\nLicense v3"), (11, "12 34 !!"), (None, "no id here at all, but ten words are in this text yes")]
    for d in range(20, 90):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["new", "other", "w7"])
        text = " ".join(w)
        if rng.random() < 0.5:
            text += "\n" + rng.choice(base)[: rng.randint(0, 80)] + "\nshort"
        made.append((d, text))
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, [(d, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}") for i, (d, t) in enumerate(rows)])


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (key(r[0]), repr(r)))


def want(rows):
    return sorted(rows, key=lambda r: (key(r[0]), repr(r)))


def test_license_scan(docs, rows):
    df = scan.scan_licenses(docs)
    columns = "doc_id n_words n_base first_word last_word base_labels".split()
    assert got(df, *columns) == want([(d, *licenses(t)) for d, t in rows])
    found = {r["doc_id"]: r for r in df.collect()}
    assert found[10]["labels"] == "gpl,mit" and found[10]["score"] == 1.0
    assert found[1]["labels"] == "" and found[1]["score"] == 0.0


def test_license_templates_tolerate_changes(spark):
    notice = " ".join(scan.TEMPLATES[12].words)
    assert scan.TEMPLATES[12].label == "mit-notice"
    changed = notice.replace("any person", "anybody or any other person").replace("restriction", "limitation")
    texts = [(1, f"x y {notice} z"), (2, changed), (3, notice.replace("free of charge", "at a price")), (4, "permission is hereby granted free of charge")]
    labels = {r["doc_id"]: r["labels"] for r in scan.scan_licenses(table(spark, texts)).collect()}
    assert labels == {1: "mit-notice", 2: "mit-notice", 3: "", 4: ""}


def test_quality_counts(docs, rows):
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    df = quality.judge(docs)
    assert got(df, *columns) == want([(d, *plain_quality(t)) for d, t in rows])
    assert df.filter("base_failed AND kept").count() == 0


def test_every_quality_rule_names_a_document(spark):
    """A page per fence that passes the base rules and fails that fence alone."""
    rng = random.Random(12)
    words = [a + b for a in "abcdefghij" for b in ("lon", "mar", "ques", "tive")]
    usual = [(d, "\n".join(prose(rng, 12, words) for _ in range(8))) for d in range(100)]
    planted = {
        "mean_word_high": " ".join(rng.choice(words) * 4 for _ in range(60)),
        "mean_word_low": " ".join(rng.choice("abc") for _ in range(9)) + " " + " ".join(chr(97 + i) + chr(97 + j) for i in range(9) for j in range(7)),
        "symbol_share_high": " ".join(f"{w}{'#' if i % 5 else ''}" for i, w in enumerate(prose(rng, 80, words).split())),
        "dup_line_share_high": "\n".join([prose(rng, 12, words) for _ in range(8)] + ["one two three"] * 6),
        "repeat_share_high": prose(rng, 70, words) + " " + " ".join(words[:5]) + " x " + " ".join(words[:5]),
    }
    rows = usual + [(1000 + i, t) for i, t in enumerate(planted.values())]
    found = {r["doc_id"]: r for r in quality.judge(table(spark, rows)).collect()}
    assert [found[1000 + i]["failed_rule"] for i in range(len(planted))] == list(planted)
    assert not any(found[1000 + i]["base_failed"] for i in range(len(planted)))
    assert all(found[d]["kept"] for d, _ in usual)


def test_quality_fences_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(13)
    rows = table(spark, [(d, prose(rng, rng.randint(10, 40))) for d in range(1500)])
    first, second = (sorted(map(tuple, quality.fences(fenced(quality.text_counts(rows.repartition(n))), 3.0, 50).collect())) for n in (2, 7))
    assert first == second


def fenced(counts):
    return counts.selectExpr("lang", "source", "word_chars / n_words AS mean_word", "0D AS symbol_share", "0D AS dup_line_share", "n_repeat_words / n_words AS repeat_share")


def test_rows_that_differ_in_another_column_only(spark):
    """Which of them stays does not depend on their order, and a mix counts each of them."""
    rows = [(1, "one two three four five six", lang, "s1") for lang in ("de", "en", "fr")] + [(2, "seven eight nine ten eleven twelve", "en", "s1")]
    kept = [
        sorted((r["doc_id"], r["lang"]) for r in ngram_join.one_of_each(table(spark, order)).collect()) for order in (rows, rows[::-1])
    ]
    assert kept == [[(1, "de"), (2, "en")]] * 2
    mixed = mixing.mixed_documents(table(spark, [*rows, rows[0]]), weights=(1,), share=2.0)
    assert sorted((r["doc_id"], r["lang"]) for r in mixed.collect()) == sorted([(1, "de")] * 4 + [(1, "en"), (1, "fr"), (2, "en")] * 2)


def test_quality_follows_the_corpus(spark):
    rng = random.Random(2)
    plain = [(i, prose(rng, 60, [f"v{i}{j}" for j in range(400)]), "en", f"s{i % 2}") for i in range(120)]
    noisy = [(i, t.replace(" ", " ## ") if i % 2 else t, "en", s) for i, t, _, s in plain]
    junk = (999, "$%& " * 3 + " ".join(f"<{i}> ||" for i in range(30)), "en", "s0")
    in_plain = {r["doc_id"]: r["kept"] for r in quality.judge(table(spark, [*plain, junk])).collect()}
    in_noisy = {r["doc_id"]: r["kept"] for r in quality.judge(table(spark, noisy)).collect()}
    assert not in_plain[999] and all(v for k, v in in_plain.items() if k != 999)
    assert all(in_noisy.values())  # where symbols are usual, they are no fault


@pytest.mark.parametrize("most", [1, 4096])
def test_substring_dedup(docs, rows, most):
    df = substring_dedup.remove_repeats(docs, 50, most_fragments=most, digests=True)
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(repeats(rows, 50))


def test_substring_dedup_counts_repeated_rows(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    df = substring_dedup.remove_repeats(table(spark, [(1, text), (1, text), (2, text[:199]), (3, "ü" + text[20:250])]))
    assert got(df, "doc_id", "n_removed") == [(1, 300), (1, 300), (2, 0), (3, 230)]
    assert {bytes(r["kept"]) for r in df.filter("doc_id = 3").collect()} == {"ü".encode()}


def test_line_dedup(docs, rows):
    kept = lines(rows, 20)
    assert got(line_dedup.dedup_lines(docs), "doc_id", "text") == want([(d, kept[d]) for d, _ in rows])


def test_line_dedup_edits(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc é") for _ in range(rng.randint(15, 40))) for _ in range(12)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                p, k = rng.randint(0, len(x)), rng.random()
                x = x[:p] + rng.choice("abcdé") + x[p + (k < 0.4) :] if k < 0.7 else x[:p] + x[p + 1 :]
            own.append(x)
        rows.append((d, "\n".join(own)))
    kept = lines(rows, 20)
    cleaned = line_dedup.dedup_lines(table(spark, rows))
    assert got(cleaned, "doc_id", "text") == want([(d, kept[d]) for d, _ in rows])
    assert cleaned.filter("n_removed > 0").count() > 20


def test_exact_dedup(docs, rows):
    columns = "doc_id keep_id group_size kept text_sha256".split()
    for bits in (1 << 27, 64):  # also with a filter that is far too small
        df = exact_dedup.exact_duplicates(docs, most_bits=bits)
        assert [r[:3] + r[4:] for r in got(df, *columns)] == [r[:3] + r[4:] for r in want(exact(rows))]
    assert df.filter("NOT kept AND doc_id <=> keep_id").count() == 0


def test_exact_dedup_filter_stays_under_its_bound():
    for rows in (0, 1, 1000, 1 << 22, 1 << 23, 10**9):
        assert 64 <= exact_dedup.filter_bits(rows, 16, 1 << 27) <= 1 << 27
    assert exact_dedup.filter_bits(10**9, 16, (1 << 27) + 5) == 1 << 27
    assert exact_dedup.filter_bits(1000, 16, 1 << 27) >= 16 * 1000


def test_exact_dedup_ties(spark):
    rows = [(5, "a b"), (3, "a b"), (4, "a  b"), (4, "a  b"), (9, None), (8, "\n"), (None, "a\tb")]
    df = exact_dedup.exact_duplicates(table(spark, rows))
    assert got(df, "doc_id", "keep_id", "group_size") == want([(d, k, n) for d, k, n, *_ in exact(rows)])


def test_mixing(docs, rows):
    df = mixing.mix(docs)
    found = [r.asDict() for r in df.collect()]
    assert len(found) == len(rows)
    sizes, taken = {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    aims = targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= max(r["size"] for r in found if r["source"] == s)
    assert got(mixing.mix(docs), "doc_id", "taken") == got(df, "doc_id", "taken")
    copies = {(r["doc_id"]): r["copies"] for r in found}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert got(out.groupBy("doc_id").count(), "doc_id", "count") == want([(d, c) for d, c in copies.items() if c])


def test_mixing_many_blocks(spark):
    rows = [(i, "w " * (i % 97 + 1), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    found = mixing.mix(table(spark, rows)).collect()
    for s in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 0.02 * own[0]["target"]


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    path = bpe.public_vocabulary()
    library = Tokenizer.from_file(path)
    odd = [(100, "<|endoftext|> a<|endoftext|>"), (101, "I'll  \n\n don't 　 x"), (102, "é́😀 \x00\x7f ١٢٣ ǅ"), (103, "  ")]
    found = bpe.encode_documents(docs.unionAll(table(docs.sparkSession, odd)), path, digests=True).collect()
    assert len(found) == len(rows) + 4
    text = dict([*rows, *odd])
    for r in found:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"en": "the of and ing tion er ly wh th sh".split(), "de": "der und sch ung keit ein über ß tz".split(), "fr": "le eau èque ment oi ç être aux".split()}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=2)) for _ in range(rng.randint(4, 80))), x) for i in range(240) for x in [rng.choice(list(parts))]]
    odd = [(1000, None, "en"), (1001, "12 !?", "en"), (1002, "", None), (1003, "Привет мой друг как дела", None), (None, "the of and there", "en")]
    df = langid.identify(table(spark, [*rows, *odd]), f"NOT {langid.FOLD}")
    found = {r["doc_id"]: r for r in df.collect()}
    held = [(i, x) for i, _, x in rows if fold(i, 4)]
    assert sum(found[i]["lang_pred"] == x for i, x in held) >= 0.97 * len(held)
    assert not any(found[i]["rejected"] for i, _, _ in rows)
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[1003]["rejected"] and found[1003]["lang_pred"] in parts
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_id_rejects_latin_junk_and_unlearned_languages(spark):
    folder = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(folder)
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    fi = "tämä on suomenkielinen teksti jossa kerrotaan talosta ja metsästä sekä siitä miten ihmiset elävät pohjoisessa kun talvi tulee".split()
    pl = "to jest tekst w języku polskim który opowiada o domu i lesie oraz o tym jak ludzie żyją na północy kiedy przychodzi zima".split()
    odd = [
        " ".join("".join(rng.choices(letters, k=6)) for _ in range(60)),
        "".join(rng.choices(letters + letters.upper() + "0123456789+/", k=400)),
        "".join(rng.choices("0123456789abcdef", k=400)),
        " ".join(rng.choices(fi, k=60)),
        " ".join(rng.choices(pl, k=60)),
        '<div class="c1"><span id=x2></span></div><br/>' * 9,
    ]
    more = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identify(docs.unionByName(more, True), f"NOT {langid.FOLD}").collect()}
    assert [found[10**9 + i]["rejected"] for i in range(len(odd))] == [True] * len(odd)
    held = [r["doc_id"] for r in docs.filter("text RLIKE '\\\\p{L}'").collect() if fold(r["doc_id"], 4)]
    assert sum(found[d]["rejected"] for d in held) <= 0.02 * len(held)


def test_lm_scoring(docs, rows):
    df = lm.score_documents(docs, f"NOT {lm.FOLD}", mu=50.0, chunk_bytes=3000)
    found = got(df, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    expected = want([(d, *x) for (d, _), x in zip(rows, plain_lm(rows, 50.0), strict=True)])
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[4:] == pytest.approx(b[4:])


def test_lm_probabilities_sum_to_one(spark):
    import numpy as np

    counts, total = np.array([3, 2, 1, 0]), 6
    pairs = np.array([0 * 4 + 1, 0 * 4 + 2, 1 * 4 + 0])
    machine = lm.Automaton(counts, pairs, np.array([2, 1, 2]), total, 3, 10.0)
    after = [10 ** (machine.score([0, w]) - machine.root[0]) for w in range(4)]
    # three words of the vocabulary and the unknown one
    assert sum(after) == pytest.approx(1.0)


def test_ngram_join(docs, rows):
    df = ngram_join.near_duplicates(docs, cells=1 << 12)
    assert got(df, "doc_id", "n_shingles", "component_id") == want(near(rows))


def test_ngram_join_families(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 90))] for _ in range(4)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for d in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if d % 5 == 0:  # one frequent passage among own words
            w = [rng.choice(words) for _ in range(20)] + passage + [rng.choice(words) for _ in range(d % 3)]
        rows.append((d, " ".join(w)))
    rows += [(500, "A B"), (501, "a\nb"), (502, "a b c")]
    df = ngram_join.near_duplicates(table(spark, rows), cells=1 << 12)
    assert got(df, "doc_id", "n_shingles", "component_id") == want(near(rows))
    kept = ngram_join.one_of_each(table(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in near(rows)})


OPERATORS = {
    "scan_licenses": lambda d: scan.scan_licenses(d),
    "judge": lambda d: quality.judge(d),
    "remove_repeats": lambda d: substring_dedup.remove_repeats(d),
    "dedup_lines": lambda d: line_dedup.dedup_lines(d),
    "exact_duplicates": lambda d: exact_dedup.exact_duplicates(d),
    "mix": lambda d: mixing.mix(d),
    "encode_documents": lambda d: bpe.encode_documents(d, bpe.public_vocabulary()),
    "identify": lambda d: langid.identify(d, "true"),
    "score_documents": lambda d: lm.score_documents(d, "true"),
    "near_duplicates": lambda d: ngram_join.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_local_checkpoints_and_no_imports_from_the_library():
    root = Path(__file__).resolve().parents[2]
    for path in (root / "daytally").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text
        if "llm" not in path.parts:
            assert "daytally.llm" not in text
