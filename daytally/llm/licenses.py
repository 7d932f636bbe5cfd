"""License scan: a positional index of the rarest licence words."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytally.llm.common import documents, each, texts


@dataclass(frozen=True)
class Template:
    """A licence text as words. `keys` must all stand in a match, word for word;
    a template without keys is a phrase and must match as a whole."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...] = ()
    base: bool = False


def template(label: str, text: str, *keys: str, base: bool = False) -> Template:
    return Template(label, tuple(text.split()), tuple(tuple(k.split()) for k in keys), base)


#: fixed values: the base phrases and well-known licence wordings, lower-cased, words only
TEMPLATES = (
    template("mit", "mit license", base=True),
    template("apache", "apache license", base=True),
    template("gpl", "general public license", base=True),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("cc-by", "licensed under cc by"),
    template("cc-by-nc", "licensed under cc by nc"),
    template("gpl-2.0", "licensed under the gnu general public license version 2", "public license version 2"),
    template("gpl-3.0", "licensed under the gnu general public license version 3", "public license version 3"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("mpl", "mozilla public license"),
    template("spdx", "spdx license identifier"),
    template(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    template(
        "apache-notice",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "except in compliance with the license",
    ),
    template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "free software foundation",
    ),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
)

#: ASCII other than letters and digits to blanks, capitals to small letters
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


class Index:
    """Postings of the templates' rarest words: word -> [(template, place)]."""

    def __init__(self, templates: tuple[Template, ...], weights: dict[str, float], anchors: int, share: float, drift: int):
        self.templates, self.share, self.drift = templates, share, drift
        self.weights = {w.encode(): x for w, x in weights.items()}
        self.words = [[w.encode() for w in t.words] for t in templates]
        self.keys = [[[w.encode() for w in k] for k in t.keys] for t in templates]
        self.total = [sum(self.weights[w] for w in ws) for ws in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, ws in enumerate(self.words):
            rarest = sorted(set(ws), key=lambda w: (-self.weights[w], w))[: anchors if templates[t].keys else 1]
            for w in rarest:
                # one posting a word and template is enough for the phrases; long
                # templates vote with every place of their rare words
                places = [i for i, x in enumerate(ws) if x == w]
                for i in places if templates[t].keys else places[:1]:
                    self.postings.setdefault(w, []).append((t, i))

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score."""
        words = words_of(text)
        found: dict[bytes, list[int]] = {}
        postings = self.postings
        for i, w in enumerate(words):
            if w in postings:
                found.setdefault(w, []).append(i)
        if not found:
            return len(words), 0, None, None, "", "", 0.0
        starts: dict[int, Counter] = {}
        # from the rarest of the file's words on, so that the templates it points to come first
        for w in sorted(found, key=lambda w: -self.weights[w]):
            for t, place in postings[w]:
                votes = starts.setdefault(t, Counter())
                for i in found[w]:
                    votes[i - place] += 1
        base, labels, base_labels, score = [], set(), set(), 0.0
        for t, votes in starts.items():
            known, n = self.words[t], len(self.words[t])
            if not self.keys[t]:
                hits = [s for s in votes if s >= 0 and words[s : s + n] == known]
                if not hits:
                    continue
                if self.templates[t].base:
                    base += hits
                    base_labels.add(self.templates[t].label)
                got = 1.0
            else:
                got = max((self._aligned(t, s, words) for s in votes), default=0.0)
                if got < self.share:
                    continue
            labels.add(self.templates[t].label)
            score = max(score, got)
        return (
            len(words),
            len(base),
            min(base, default=None),
            max(base, default=None),
            ",".join(sorted(base_labels)),
            ",".join(sorted(labels | base_labels)),
            score,
        )

    def _aligned(self, t: int, start: int, words: list[bytes]) -> float:
        """The share of the template's weight that stands in place, up to `drift`
        words off; 0 unless all key phrases stand there word for word."""
        known, drift = self.words[t], self.drift
        window = words[max(0, start - drift) : start + len(known) + drift]
        for key in self.keys[t]:
            if not any(window[i : i + len(key)] == key for i in range(len(window) - len(key) + 1)):
                return 0.0
        shift = max(0, start - drift) - start
        got = 0.0
        for i, w in enumerate(known):
            at = i - shift
            if w in window[max(0, at - drift) : at + drift + 1]:
                got += self.weights[w]
        return min(1.0, got / self.total[t])


def licence_word_weights(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """The inverse document frequency, over all rows, of every word of the
    templates. Batches are counted before the shuffle; what reaches the driver
    is one number a template word, whatever the input."""
    vocabulary = frozenset(w.encode() for t in templates for w in t.words)

    def one(batch):
        counts = Counter()
        for text in texts(batch):
            counts.update(vocabulary.intersection(words_of(text)))
        return [[None, *(w.decode() for w in counts)], [batch.num_rows, *counts.values()]]

    counted = docs.select("text").mapInArrow(each(one, {"word": pa.string(), "n": pa.int64()}), "word string, n long")
    df = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(None, 0)
    return {w.decode(): math.log((total + 1) / (df.get(w.decode(), 0) + 1)) + 1 for w in sorted(vocabulary)}


def scan_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, anchors: int = 6, share: float = 0.7, drift: int = 4
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of other than ASCII, A-Z
    lower-cased. The index posts each template's rarest words (by document
    frequency over all rows) with their places. A file's rare licence words point
    to templates, a posting and a place in the file give a start, and starts with
    votes are verified: a phrase must stand there as a whole; a longer template
    needs its mandatory key phrases and `share` of its weight within `drift`
    words of where it belongs. Phrases are found at every place of the whole text,
    since each place holds the phrase's rarest word.

    n_base, first_word and last_word (null where n_base is 0) count the places of
    the base phrases; labels are distinct, sorted and comma-joined, empty where
    there are none; score is 1 for a phrase and else the best share, 0 to 1.
    Null text has no words. Repeated rows are each reported, an empty table gives
    an empty result, and columns other than doc_id and text are ignored. No
    shuffle but that of the word counts; each text is held alone.
    """
    weights = licence_word_weights(docs, templates)
    columns = {
        "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    }

    def one(batch):
        index = Index(templates, weights, anchors, share, drift)
        rows = [index.scan(t) for t in texts(batch)]
        return [batch.column("doc_id"), *map(list, zip(*rows, strict=True))]

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(each(one, columns), schema)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
