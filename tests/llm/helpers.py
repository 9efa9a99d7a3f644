"""Small tables of difficult rows, and brute-force versions of the operators."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, doc string, h long, head long, _n int"


def words(text):
    return WORD.findall(text or "")


def odd_rows(seed=1, n=60):
    """Nulls in every column, empty, blank, very long and repeated texts, near copies, repeated rows, shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "naïve.", "日本語", "x,", "The"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(n):
        kind = i % 10
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if kind == 1:
            w = w[:40] + passage + w[40:]
        elif kind == 2:
            w = base[:]
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 3:
            w = base[:]
        elif kind == 4:
            w = ["a", "b"] * rng.randint(1, 40)
        rows.append((i, " ".join(w) if kind % 2 else "\n".join(w), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None]), None, i, i, "x", i, i, 1))
    extra = [(None,), ("",), (" \t\n\x0b\x0c\r ",), ("one",), ("a b c",), (" ".join(rng.choice(vocabulary) for _ in range(30_000)),)]
    rows += [(n + k, t, None, None, None, None, None, None, None, None, None) for k, (t,) in enumerate(extra)]
    rows += [(None, rows[3][1], "en", "s1", 3, 1, 1, "y", 1, 1, 1), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[5], rows[5], rows[12]]
    return rows


def odd(spark, **kw):
    return spark.createDataFrame(odd_rows(**kw), SCHEMA).repartition(4)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(texts, size, per):
    """Links of every pair of (key, text) by brute force; the component of each position."""
    sets = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= per * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def removed(rows, size):
    """Kept words and removed counts of (key, text), a null key last; equal (key, place) are ties."""
    first = {}
    last = 1 << 63
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            at = (last if key is None else key, i)
            t = tuple(w[i : i + size])
            first[t] = min(first.get(t, at), at)
    out = []
    for key, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (last if key is None else key, i):
                gone.update(range(i, i + size))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeats(w, size=5):
    c = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    covered = set()
    for i in range(len(w) - size + 1):
        if c[tuple(w[i : i + size])] > 1:
            covered.update(range(i, i + size))
    return len(covered)
