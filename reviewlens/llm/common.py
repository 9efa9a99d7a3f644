"""What the training-data operators share: scratch tables, words, ranks, numpy hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import reviewlens

# Functions sent to Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(reviewlens)

#: Fixed value: the white space between words, and its characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; over all cores where its files have fewer splits than there are cores, as one small file has."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


# --- scratch ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it; on one machine alone a temporary one where none is set.

    Checkpoints made here go when the last table that reads them does.
    """
    spark._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext.getCheckpointDir()
        if made:
            return made
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="reviewlens-")
        spark.sparkContext.setCheckpointDir(path)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Intermediate Parquet tables in the shared folder, removed on leaving the block.

    Whatever outlives the block must not read them: pass it through ``keep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; Spark removes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_python(df: DataFrame, run, schema) -> DataFrame:
    """``df.transform(in_python, run, schema)`` in bounded memory.

    Batches are bounded by bytes, so that long texts can't fill a worker, and a worker hands its free
    memory back at a task's end, as Spark keeps it for later tasks beside the JVM's own.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if not now or not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return df.mapInArrow(lean, schema)


#: Bytes of an Arrow batch of texts, unless a single row has more.
BATCH_BYTES = 2 << 20


# --- columns ---------------------------------------------------------------


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body`` as a variable (a lambda body would repeat it per element)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; no words for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` cut from its lineage, marked for broadcast only if it has at most ``rows`` rows."""
    df = keep(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of a table of counts that may be broadcast (under 32 bytes each, so 6 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def in_order(df: DataFrame, order: list, out: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Number all rows from 0 in the order ``order``: adds ``out`` (long), and for each of ``sums`` the sum over the rows before (double).

    A sort by ranges, in which ties of one key alone stay together; each range numbers its own rows, and
    the ranges' counts and sums, one row for each, carry on from one to the next. No task sees all rows.
    Rows equal in ``order`` are numbered in any order. Columns ``_m`` and ``_p`` and those ending in ``_0`` must not clash.
    """
    sums = sums or {}
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = keep(rows.withColumn("_p", F.shiftright("_m", 33)).withColumn("_m", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))))
    per = rows.groupBy(F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"{s}_0") for s, c in sums.items()])
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"{s}_0").over(before), F.lit(0.0)).alias(f"{s}_0") for s in sums])
    # as many rows as ranges: thousands
    rows = rows.join(F.broadcast(per), F.col("_p") == F.col("_q"))
    inside = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({out: (F.col("_n") + F.col("_m")).cast("long"), **{s: F.col(f"{s}_0") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for s, c in sums.items()}})
    return rows.drop("_m", "_p", "_q", "_n", *[f"{s}_0" for s in sums])


def _same(left: DataFrame, group: list[str]) -> Column:
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & left[g].eqNullSafe(F.col(f"_g{i}"))
    return on


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, spread: str, count: str | None = None, per_bucket: int = 4000) -> DataFrame:
    """Number the rows of each group from 0 in the order ``spread`` (as unsigned), then ``order``.

    ``spread`` names a column of evenly spread longs (a hash). The rows of a group fall into buckets
    by ``spread``, about ``per_bucket`` rows each, so no group however large meets in one task, unless its rows
    have few different hashes (rows of one key); the
    buckets' counts, far fewer than the rows, give each bucket its first number. ``count``: a name
    for the group's number of rows. Adds ``out``; other columns starting with ``_`` must not clash.
    """
    names = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    share = F.shiftrightunsigned(F.col(spread), 11).cast("double") / float(1 << 53)
    sizes = small(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).select(*names, "_size"), BROADCAST_ROWS)
    keyed = df.join(sizes, _same(df, group), "inner").drop(*[f"_g{i}" for i in range(len(group))])
    keyed = keyed.withColumn("_b", F.floor(share * F.ceil(F.col("_size") / per_bucket)).cast("long"))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    first = small(counts.select(*names, F.col("_b").alias("_b2"), F.coalesce(before, F.lit(0)).alias("_first")), BROADCAST_ROWS)
    here = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(F.shiftrightunsigned(F.col(spread), 1), *order))
    local = keyed.withColumn("_r", here)
    done = local.join(first, _same(local, group) & (local["_b"] == F.col("_b2")))
    done = done.withColumn(out, (F.col("_first") + F.col("_r") - 1).cast("long"))
    if count:
        done = done.withColumn(count, F.col("_size"))
    return done.drop("_first", "_r", "_b", "_b2", "_size", *[f"_g{i}" for i in range(len(group))])


# --- numpy: word hashes of a batch of texts ---------------------------------

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words of a batch, and the index of each text's first word (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~_WHITE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cut = at[1:-1]
    cut = cut[cut < len(raw)]
    begins[cut] |= solid[cut]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = cut[cut > 0] - 1
    ends[last] |= solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: its 8-byte pieces, mixed one after the other, with its length."""
    size = end - start
    out = mix(size.astype(np.uint64) + _R)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    pieces = np.lib.stride_tricks.sliding_window_view(padded, 8)
    full = (np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))) - np.uint64(1)
    todo, at = np.arange(len(start)), 0
    while len(todo):
        left = size[todo] - at
        piece = pieces[start[todo] + at].copy().view(np.uint64).ravel()
        short = left < 8
        if short.any():
            piece[short] &= full[left[short]]
        out[todo] = mix((out[todo] ^ piece) * _R + np.uint64(at + 1))
        at += 8
        todo = todo[left > 8]
    return out


def window_hashes(of_words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes (across text borders too)."""
    n = len(of_words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _R + of_words[i : i + n]
    return mix(out)


# --- streams of batches -----------------------------------------------------


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one, up to ``most`` bytes of text together; a batch of more stays as it is."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = int(text_buffers(batch.column(batch.schema.get_field_index(column)))[1][-1])
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the consecutive rows with equal ``key`` from batches sorted by it; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(k)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != part.column(part.schema.get_field_index(key))[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
