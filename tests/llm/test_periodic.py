"""Runs of words against a search of every period and place."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from reviewlens.llm import periodic, queries
from tests.llm.helpers import none, odd, odd_rows, words


def all_runs(w, least, times):
    """(start, length, period) of maximal stretches equal one period apart, by start and period, with their smallest period alone."""
    found = []
    number = {x: i for i, x in enumerate(w)}
    w = np.array([number[x] for x in w], np.int64)
    for p in range(1, len(w) // times + 1):
        equal = np.concatenate([[0], w[p:] == w[:-p], [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(equal)).tolist()
        found += [(a, b - a + p, p) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a + p >= max(least, times * p)]
    smaller = lambda s, n, p: any(q < p and p % q == 0 and a <= s and a + m >= s + n for a, m, q in found)
    return sorted((r for r in found if not smaller(*r)), key=lambda r: (r[0], r[2]))


def judged(key, text, tail=True):
    w = words(text)
    n = len(w)
    if tail and key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    r = all_runs(w, 6, 4)
    gone = {i for s, m, p in r for i in range(s + p, s + m)}
    best = max(r, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    listed, left = "".join("%d,%d,%d\n" % x for x in r), " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(r), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(left)), listed, left


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_all_runs_of_many_sequences():
    rng = random.Random(3)
    for _ in range(250):
        seqs = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 2, 5, 20, 60])
            s = [rng.randrange(k) for _ in range(n)]
            if s and rng.random() < 0.4:
                s = s + s[: rng.randint(1, n)] * rng.randint(1, 6) + s[:3]
            seqs.append(s)
        first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
        ids = np.array([x for s in seqs for x in s], np.int64)
        for least, times in ((2, 2), (6, 4), (1, 3)):
            got = [[] for _ in seqs]
            for k, *r in zip(*(x.tolist() for x in periodic.runs(ids, first, least, times)), strict=True):
                got[k].append(tuple(r))
            assert got == [all_runs(s, least, times) for s in seqs]


def test_suffix_array_and_extensions():
    rng = random.Random(5)
    for _ in range(40):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        n = len(s)
        x = periodic.Suffixes(np.array(s, np.int64), np.zeros(n, np.int64), np.full(n, n))
        assert x.rank.tolist() == [sorted(range(n), key=lambda i: s[i:]).index(i) for i in range(n)]
        assert x.next_smaller().tolist() == [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) for i in range(n)]
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        if pairs:
            got = x.extension(*(np.array(v) for v in zip(*pairs, strict=True)))
            assert got.tolist() == [common(s[i:], s[j:]) for i, j in pairs]


def test_difficult_rows(spark):
    rows = [(i, t, "x") for i, (_, t, *_) in enumerate(odd_rows())]
    rows += [(500, "a " * 5_000, "x"), (501, "a b c d " * 20 + "e", "x"), (502, "x x x x x", "x"), (503, "x x x x x x", "x"), (None, "y " * 9, None), (502, "x x x x x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, START string").repartition(3)
    done = periodic.collapse(docs, key="doc_id", tail=periodic.repeated_tail)
    assert done.columns == ["doc_id", "text", *COLUMNS, "runs", "collapsed"]
    got = done.collect()
    assert len(got) == len(rows)
    for r in got:
        want, listed, left = judged(r.doc_id, r.text)
        assert tuple(r[c] for c in COLUMNS) == want and r.runs == listed and r.collapsed == left


def test_without_a_key_or_a_tail(spark):
    docs = odd(spark)
    for r in periodic.collapse(docs).collect():
        assert tuple(r[c] for c in COLUMNS) == judged(None, r.text)[0]
    assert periodic.collapse(none(spark)).count() == 0


def test_slices_change_nothing(spark, monkeypatch):
    docs = odd(spark).where("doc_id is not null")
    one = sorted(map(tuple, periodic.collapse(docs, key="doc_id", tail=periodic.repeated_tail).select("doc_id", *COLUMNS).collect()))
    monkeypatch.setattr(periodic, "SLICE_BYTES", 300)
    assert one == sorted(map(tuple, periodic.collapse(docs, key="doc_id", tail=periodic.repeated_tail).select("doc_id", *COLUMNS).collect()))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").where(F.length("text") < 6000).collect()}
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, d).collect()}
    assert len(rows) == 200
    for k, t in texts.items():
        assert tuple(rows[k][c] for c in COLUMNS) == judged(k, t)[0]
