"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from daytally.llm.common import KEPT, documents, each, texts

#: fixed values: how byte-level BPE cuts a text into words
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 1 << 40


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    where printable, else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Words(dict):
    """The encoding of each word met, as little-endian 32-bit ids; two generations,
    so that the memory is bounded and frequent words stay."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str, most_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.cut = regex.compile(CUT)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self._word, most_words)

    def merged(self, data: bytes) -> list[int]:
        """The ids of one word.

        The leaves of the tree hold rank * n + place for the pair that starts at
        each place, so that its root is the leftmost of the lowest-ranked pairs.
        A merge changes the leaves of the pair, of the one before it and of the
        symbol that goes; each change climbs to the root, and stops where a
        node keeps its value.
        """
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        size = 1 << (n - 1).bit_length()
        tree = [NO_PAIR * n] * (2 * size)
        for i in range(n - 1):
            pair = merges.get((ids[i], ids[i + 1]))
            if pair:
                tree[size + i] = pair[0] * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        nobody = NO_PAIR * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < nobody:
            i = tree[1] % n
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            p = before[i]
            pair = None
            if k < n:
                before[k] = i
                pair = merges.get((ids[i], ids[k]))
            changes = [(i, pair), (j, None)]
            if p >= 0:
                changes.append((p, merges.get((ids[p], ids[i]))))
            for at, pair in changes:
                value = pair[0] * n + at if pair else nobody
                node = size + at
                while tree[node] != value:
                    tree[node] = value
                    if node == 1:
                        break
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        return np.array(self.merged(word.encode()), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers. Special
        tokens in the text are themselves."""
        words, find = self.words, self.cut.findall
        if self.split is None or not any(token in text for token in self.special):
            return b"".join(map(words.__getitem__, find(text)))
        parts = []
        for part in self.split.split(text):
            if part in self.special:
                parts.append(self.special[part].to_bytes(4, "little"))
            else:
                parts.extend(map(words.__getitem__, find(part)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """One vocabulary per worker process, until a task of another operator runs there."""
    return ByteBpe(path)


KEPT["bpe"] = vocabulary.cache_clear


def encode_documents(docs: DataFrame, path: str, ids: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids (array of int), ids_sha256, decoded_sha256.

    Every whole text is encoded where it is read: no shuffle, one text at a time.
    Null text counts as empty, with no tokens. Repeated rows are each encoded; an
    empty table gives an empty result; other columns are ignored. `path` names the
    vocabulary file, which every executor must be able to open.
    """
    columns = {"doc_id": pa.int64(), "n_tokens": pa.int64()}
    if ids:
        columns["ids"] = pa.list_(pa.int32())
    if digests:
        columns |= {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def one(batch):
        bpe = vocabulary(path)
        coded = [bpe.encode(t.decode()) for t in texts(batch)]
        made = [batch.column("doc_id"), [len(c) // 4 for c in coded]]
        if ids:
            ends = np.cumsum([0, *made[1]]).astype("int32")
            made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4"))))
        if digests:
            made.append([hashlib.sha256(c).hexdigest() for c in coded])
            made.append([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded])
        return made

    types = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join(f"{c} {types[c]}" for c in columns)
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(each(one, columns, "bpe"), schema)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_vocabulary(), ids=False, digests=True)
