"""Whitening of embeddings by exact sums: integers in slices of digits, multiplied as float64 matrices.

Vectors become integers x. With n distinct ones and their sums S, the centred integers z = n * x - S are cut
into signed digits so small that a product of two blocks of digits is exact in float64, whatever the
order of its additions. The products are put together as integers of any size, cut again into digits that
Spark adds up as longs, and the covariance is n ** -3 of their sum: exact until it is rounded once.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, StructField, StructType

from reviewlens.llm.common import Scratch, in_python, keep

#: Bits of a digit, and rows of a block: BLOCK * 2 ** (2 * (BITS - 1)) <= 2 ** 53, so that products are exact.
BITS, BLOCK = 21, 4096
#: Bits of the digits in which tasks hand on their sums: 2 ** 31 tasks may be added as longs.
CARRY = 32
#: Integers whose bound is below this are added and multiplied as longs, others as integers of any size.
LONG = 1 << 62


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """Entries as doubles, times ``scale``, rounded down to longs; beyond the longs, the nearest of these."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of longs as rows of ``dims`` entries; shorter lists end in zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def digits(z: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Signed digits of ``bits`` bits, the lowest first, as float64: z = sum of digit k * 2 ** (bits * k), each at most 2 ** (bits - 1) in size."""
    out, half, mask = [], 1 << (bits - 1), (1 << bits) - 1
    while True:
        low = ((z + half) & mask) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> bits
        if not z.any():
            return out


def gram(z: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The exact product of the transpose of ``z`` and ``z``, of at most ``BLOCK`` rows, as integers of any size."""
    parts = digits(z, bits)
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for a, left in enumerate(parts):
        for b, right in enumerate(parts[a:], a):
            product = (left.T @ right).astype(np.int64).astype(object)
            total += (product if a == b else product + product.T) << (bits * (a + b))
    return total


def centred(x: np.ndarray, n: int, sums: np.ndarray, bound: int) -> np.ndarray:
    """n * x - S, as longs where ``bound`` says that they fit."""
    if bound < LONG:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _carried(values: list[int]) -> list[list[int]]:
    """Integers as rows of signed digits of ``CARRY`` bits, of equal length."""
    out = []
    for v in values:
        row, sign = [], -1 if v < 0 else 1
        v = abs(v)
        while v:
            row.append(sign * (v & ((1 << CARRY) - 1)))
            v >>= CARRY
        out.append(row)
    return out


def _added(parts: DataFrame) -> dict[int, int]:
    """Rows of (``place``, ``digits``), one for each task, added up by Spark; a row for each place comes to the driver."""
    each = parts.select("place", F.posexplode("digits").alias("digit", "value"))
    rows = each.groupBy("place", "digit").agg(F.sum("value").alias("value")).collect()
    out: dict[int, int] = {}
    for r in rows:
        out[r.place] = out.get(r.place, 0) + (r.value << (CARRY * r.digit))
    return out


def _sums(x: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """How many vectors, their sums by dimension, and the largest entry's size."""

    def run(batches):
        n, total, most = 0, np.zeros(dims, object), 0
        for batch in batches:
            rows = matrix(batch.column(0), dims)
            for a in range(0, len(rows), 1 << 20):
                block = rows[a : a + (1 << 20)]
                total += ((block >> 32).sum(axis=0).astype(object) << 32) + (block & 0xFFFFFFFF).sum(axis=0).astype(object)
                most = max(most, int(block.max(initial=0)), -int(block.min(initial=0)))
            n += len(rows)
        yield from _rows([n, *total.tolist()], most)

    parts = keep(x.transform(in_python, run, "place int, digits array<long>, most decimal(38,0)"))
    added = _added(parts)
    most = parts.agg(F.max("most")).first()[0]
    return added.get(0, 0), [added.get(k + 1, 0) for k in range(dims)], int(most or 0)


def _rows(values: list[int], most: int = 0):
    from decimal import Decimal

    yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(_carried(values), pa.list_(pa.int64())), pa.array([Decimal(most)] * len(values), pa.decimal128(38, 0))], ["place", "digits", "most"])


def _scatter(x: DataFrame, dims: int, n: int, sums: list[int], bound: int) -> list[list[int]]:
    """The sum of the products of the centred integers, exact."""
    s = np.array(sums, object)
    upper = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((dims, dims), object)
        for batch in batches:
            rows = matrix(batch.column(0), dims)
            for a in range(0, len(rows), BLOCK):
                total += gram(centred(rows[a : a + BLOCK], n, s, bound))
        yield from _rows(total[upper].tolist())

    added = _added(x.transform(in_python, run, "place int, digits array<long>, most decimal(38,0)"))
    out = [[0] * dims for _ in range(dims)]
    for k, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
        out[i][j] = out[j][i] = added.get(k, 0)
    return out


def eigen(scatter: list[list[int]], n: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first ``count`` eigenvalues above zero and unit eigenvectors (columns) of ``scatter`` / n ** 3, and the trace.

    LAPACK's vectors are improved in extended precision against the exact matrix, so that a large mean or a wide
    spread of eigenvalues costs no digits. Values that double precision can't tell from zero have no direction and are left out.
    """
    dims = len(scatter)
    top = max((abs(v) for row in scatter for v in row), default=0)
    if not top:
        return np.zeros(0), np.zeros((dims, 0)), 0.0
    # a power of two brings the largest entry near one; entries as the sum of two doubles
    unit = Fraction(1 << top.bit_length())
    exact = [[Fraction(v) / unit for v in row] for row in scatter]
    high = np.array([[float(v) for v in row] for row in exact])
    low = np.array([[float(v - Fraction(h)) for v, h in zip(row, hs, strict=True)] for row, hs in zip(exact, high.tolist(), strict=True)])
    a = high.astype(np.longdouble) + low.astype(np.longdouble)
    values, vectors = np.linalg.eigh(high)
    x = vectors[:, ::-1].astype(np.longdouble)
    for _ in range(2):
        r, s = np.eye(dims, dtype=np.longdouble) - x.T @ x, x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        small = np.abs(gap) <= 2 * (np.abs(s - np.diag(e)).max() + np.abs(e).max() * np.abs(r).max())
        change = np.where(small, r / 2, (s + e[None, :] * r) / np.where(small, 1, gap))
        x = x + x @ change
    x /= np.sqrt((x * x).sum(axis=0))
    e = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-e, kind="stable")[:count]
    order = order[(e[order] > dims * np.finfo(float).eps * e.max())]
    factor = unit / Fraction(n) ** 3
    real = [float(Fraction(float(v)) * factor) for v in e[order]]
    trace = float(sum(Fraction(scatter[k][k]) for k in range(dims)) / Fraction(n) ** 3)
    return np.array(real), x[:, order].astype(np.float64), trace


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each row with a finite vector and each component: ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    The fit is over each distinct integer vector once (``scaled``), divisor n. ``deviation``: the squared
    distance from the mean times n squared, exact, as a decimal of 38 digits, null beyond. ``whitened``: the
    centred integers divided by n, projected on the component, divided by its deviation. ``explained``: the
    component's share of the trace. ``identity_error``: the largest entry of the covariance of ``whitened``
    over the fit list, minus the identity, measured on the values themselves.

    Rows whose vector is null or holds a null or non-finite entry are left out. Shorter vectors end in zeros.
    Repeated rows repeat. Where the fit has fewer directions than ``components`` (few or equal vectors), those alone come out;
    with none, or with no rows, nothing does. Columns of the added names are replaced, whatever their case; others stay.
    """
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in df.columns if c.lower() not in names]
    rows = df.where(finite(F.col(vector))).select(*[F.col(f"`{c}`") for c in kept], scaled(F.col(vector), scale).alias("_x"))
    with Scratch(df.sparkSession) as tmp:
        # equal vectors meet in a partial aggregate before they move
        x = tmp.write(rows.select("_x").distinct(), "vectors")
        dims = x.agg(F.max(F.size("_x"))).first()[0] or 0
        n, sums, most = _sums(x, dims)
        bound = n * most + max([abs(s) for s in sums], default=0)
        values, vectors, trace = eigen(_scatter(x, dims, n, sums, bound), n, components) if n and dims else (np.zeros(0), np.zeros((dims, 0)), 0.0)
        s = np.array(sums, object)
        wide = (bound * bound * max(dims, 1)).bit_length() < 62

        def project(xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = centred(xs, n, s, bound)
            return z, ((z / n).astype(np.float64) @ vectors) / np.sqrt(values)

        def run(batches):
            from decimal import Decimal

            for batch in batches:
                z, white = project(matrix(batch.column(len(kept)), dims))
                square = (z * z).sum(axis=1) if wide else (z.astype(object) ** 2).sum(axis=1)
                far = pa.array([Decimal(int(v)) if v < 10**38 else None for v in square.tolist()], pa.decimal128(38, 0))
                entries = pa.array([[{"component": k + 1, "whitened": w, "explained": e} for k, (w, e) in enumerate(zip(row, shares, strict=True))] for row in white.tolist()], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], far, entries], [*kept, "_far", "_each"])

        def probe(batches):
            for batch in batches:
                white = project(matrix(batch.column(0), dims))[1]
                yield pa.RecordBatch.from_arrays([pa.array(white.tolist(), pa.list_(pa.float64()))], ["w"])

        shares = [float(v / trace) for v in values]
        kind = pa.list_(pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())]))
        pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
        error = 0.0
        if pairs:
            w = x.transform(in_python, probe, "w array<double>")
            cov = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
            error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
        schema = StructType([*rows.schema.fields[:-1], StructField("_far", DecimalType(38, 0)), StructField("_each", ArrayType(StructType([StructField("component", IntegerType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType())])))])
        out = rows.transform(in_python, run, schema)
    out = out.withColumn("_each", F.explode("_each"))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("_each.component").alias("component"), F.lit(n).cast("long").alias("n"), F.col("_far").alias("deviation"), F.col("_each.whitened").alias("whitened"), F.col("_each.explained").alias("explained"), F.lit(float(error)).alias("identity_error"))
