"""Whitening against exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, N string"


def brute(vectors, dims, components=4):
    """n, the deviations by vector, eigenvalues, vectors, trace from exact fractions and one eigendecomposition."""
    x = [tuple(v) + (0,) * (dims - len(v)) for v in vectors]
    fit = sorted(set(x))
    n, s = len(fit), [sum(v[k] for v in fit) for k in range(dims)]
    z = {v: [n * a - b for a, b in zip(v, s, strict=True)] for v in fit}
    cov = [[Fraction(sum(z[v][i] * z[v][j] for v in fit), n**3) for j in range(dims)] for i in range(dims)]
    e, w = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    return n, z, x, e[::-1][:components], w[:, ::-1][:, :components], float(sum(cov[k][k] for k in range(dims)))


def scaled(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def held(rows, vectors, dims):
    n, z, x, e, w, trace = brute(vectors, dims)
    real = [k for k in range(len(e)) if e[k] > 1e-12 * max(e[0], 1e-300)]
    by_id = dict(zip(range(len(vectors)), x, strict=True))
    assert len(rows) == len(vectors) * len(real)
    for r in rows:
        k, own = r.component - 1, z[by_id[r.vec_id]]
        assert r.n == n and int(r.deviation) == sum(c * c for c in own)
        assert r.explained == pytest.approx(e[k] / trace, rel=1e-9) and r.identity_error < 1e-9
    for k in real:
        got = np.array([r.whitened for r in sorted(rows, key=lambda r: r.vec_id) if r.component == k + 1])
        want = np.array([float(sum(Fraction(c, n) * Fraction(float(a)) for c, a in zip(z[v], w[:, k], strict=True))) / math.sqrt(e[k]) for v in x])
        sign = 1 if got @ want >= 0 else -1
        assert np.allclose(got, sign * want, atol=1e-6)


def test_against_fractions(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 3 - d / 4) for d in range(8)] for _ in range(60)]
    vectors += vectors[:10] * 3
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    done = whitening.whiten(df)
    assert done.columns == ["vec_id", "embedding", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(done.collect(), [scaled(v) for v in vectors], 8)


def test_large_means_keep_their_digits(spark):
    rng = random.Random(2)
    vectors = [[1e13 + rng.gauss(0, 2) * 1e3, -3e14 + rng.gauss(0, 1) * 1e3, rng.gauss(0, 5)] for _ in range(50)]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))
    held(whitening.whiten(df).collect(), [[math.floor(256 * c) for c in v] for v in vectors], 3)


def test_rows_left_out_and_odd_lengths(spark):
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [0.0, -float("inf")]]
    good = [[1.0, 2.0, 3.0], [2.0, -1.0], [0.5], [], [4.0, 4.0, -4.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(good)] + [(100 + i, v, "x") for i, v in enumerate(bad)], SCHEMA)
    held(whitening.whiten(df).collect(), [scaled(v) for v in good], 3)


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None, None)], [(1, [], None)], [(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 40, 1 << 61])
def test_products_of_digits_are_exact(size):
    rng = random.Random(size)
    z = [[rng.randint(-size, size) for _ in range(5)] for _ in range(300)] + [[size] * 5, [-size] * 5]
    want = [[sum(r[i] * r[j] for r in z) for j in range(5)] for i in range(5)]
    assert whitening.gram(np.array(z, np.int64)).tolist() == want
    assert whitening.gram(np.array(z, object)).tolist() == want
    wide = [[c * 12345678901234567890 for c in r] for r in z]
    assert whitening.gram(np.array(wide, object)).tolist() == [[c * 12345678901234567890**2 for c in r] for r in want]


def test_a_full_block_of_the_largest_digits_is_exact():
    z = np.full((whitening.BLOCK, 2), -(1 << (whitening.BITS - 1)), np.int64)
    assert whitening.gram(z).tolist() == [[whitening.BLOCK << (2 * whitening.BITS - 2)] * 2] * 2


def test_query(spark):
    d = "/root/testdata/sf0.001"
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    rows = queries.op13_whitening(spark, d).orderBy("vec_id", "component").collect()
    assert [f.dataType.simpleString() for f in queries.op13_whitening(spark, d).schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    ids = sorted(table)
    n, z, x, e, w, trace = brute([scaled(table[i]) for i in ids], 64)
    own = dict(zip(ids, x, strict=True))
    assert len(rows) == 4 * len(ids)
    for r in rows[:: 37]:
        assert (r.n, r.deviation) == (n, sum(c * c for c in z[own[r.vec_id]]))
        white = float(np.array([c / n for c in z[own[r.vec_id]]]) @ w[:, r.component - 1]) / math.sqrt(e[r.component - 1])
        assert abs(abs(r.whitened) - abs(white)) < 1e-6 and abs(r.explained - e[r.component - 1] / trace) < 1e-10
