"""Plain Python versions of the text operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(doc_id, n):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == 2


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    starts, labels = [], set()
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += hits
        labels |= {label} if hits else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def one_edit(s, t):
    if abs(len(s) - len(t)) > 1:
        return False
    s, t = sorted((s, t), key=len)
    i = 0
    while i < len(s) and s[i] == t[i]:
        i += 1
    return s[i + 1 :] == t[i + 1 :] if len(s) == len(t) else s[i:] == t[i + 1 :]


def lines(rows, least):
    """doc_id -> text that stays; rows have distinct doc_ids."""
    seen, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: key(r[0])):
        kept = []
        for line in (text or "").split("\n"):
            x = line.strip(BLANKS)
            if len(x) >= least:
                if not any(one_edit(x, y) for y in seen):
                    kept.append(line)
                seen.append(x)
            else:
                kept.append(line)
        out[doc_id] = None if text is None else "\n".join(kept)
    return out


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), *key(doc_id), doc_id))
    out = []
    for doc_id, text in rows:
        t = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[t])[3]
        out.append((doc_id, keep, len(groups[t]), doc_id == keep, sha(t)))
    return out


def targets(sizes, share=1.5, most=2):
    """source -> target by resharing until nothing is above its cap; sizes: source -> size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows, percent=80):
    """(doc_id, set size, component) by comparing all pairs that share a shingle; rows have distinct doc_ids."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in index[x])
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                top[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return [(d, len(sets[i]), best.get(find(i))) for i, (d, _) in enumerate(rows)]


def lm(rows, mu):
    """(n_tokens, n_known, train_tokens, base_score, score) of each row."""
    tokens = [[*WORD.findall(lower(t)), " "] for _, t in rows]
    one, two = Counter(), Counter()
    for (doc_id, _), w in zip(rows, tokens, strict=True):
        if not fold(doc_id, 7):
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
    total, distinct = sum(one.values()), len(one)
    out = []
    for w in tokens:
        p = [(one[x] + 1) / (total + distinct + 1) for x in w]
        score = math.log10(p[0]) + sum(
            math.log10((two[a, b] + mu * q) / (one[a] + mu)) for a, b, q in zip(w, w[1:], p[1:], strict=False)
        )
        out.append((len(w), sum(one[x] > 0 for x in w), total, sum(map(math.log10, p)), score))
    return out


def cycled(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return list(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs(words):
    """(start, length, period) of all runs: period by period, word by word."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic(doc_id, text):
    words = cycled(WORD.findall(text or ""), doc_id)
    found = runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    milli = 1000 * best[1] // best[2] if found else None
    return len(found), *best, milli, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def spans(text, items, size):
    """Which words of the text stand in a window of an item, and whose windows occur."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, named = word.findall(lower(text)), set(), set()
    for item_id, item in items:
        w = word.findall(lower(item))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            part = w[i : i + size]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    named.add(str(item_id))
    return len(words), hit, sorted(named)


def negatives(rows, is_anchor, positives=5, best=10, low=30, high=90):
    """rows: vec_id, label, vector"""
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            made = (label, [math.floor(256 * x) for x in v])
            good[i] = min(good.get(i, made), made)
    out = []
    for a in filter(is_anchor, good):
        scored = sorted((-sum(map(int.__mul__, good[a][1], v)), i, label) for i, (label, v) in good.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == good[a][0]][:positives]:
            fits = [(n, -t) for t, n, label in scored if label != good[a][0] and -low * s <= -100 * t <= -high * s][:best]
            out += [(a, i, k + 1, n, -s, t) for k, (n, t) in enumerate(fits)]
    return sorted(out)
