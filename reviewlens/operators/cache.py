"""Content-addressed results: lookup, misses, write-back, expiry and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import cache_key, context_hash

# Fixed values.
HOURS, NEWEST = 24, 500


def keyed(entries: DataFrame, model: str | None, rules: list[str] | None, language: str | None, pipeline: bool, prompt_hash: str | None = None) -> DataFrame:
    return entries.withColumn("key", cache_key(F.col("file_path"), F.col("content"), context_hash(model, rules, language, pipeline, prompt_hash)))


def fresh(cache: DataFrame, now, hours: int = HOURS) -> DataFrame:
    """SRC15: entries that are not older than ``hours``."""
    return cache.where(F.col("written_at") > F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))


def hits(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """JN1: entries with their cached issues. Equal files share a key, so the cache side is one row a key: the newest."""
    return entries.join(latest(cache), "key")


def misses(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """JN1."""
    return entries.join(cache.select("key"), "key", "left_anti")


def evicted(cache: DataFrame, newest: int = NEWEST) -> DataFrame:
    """All but the ``newest`` entries: found by a bounded top-k and an anti-join, without a global sort."""
    kept = cache.orderBy(F.desc("written_at"), "key").limit(newest)
    return cache.join(F.broadcast(kept.select("key")), "key", "left_anti") if newest <= 100_000 else cache.join(kept.select("key"), "key", "left_anti")


def to_write(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """JN15: each entry's issues under its key; issues without a file of the review go to its first file."""
    first = entries.groupBy("review_id").agg(F.min_by("file_path", "ord").alias("_first"))
    known = entries.select("review_id", F.col("file_path").alias("file"), F.lit(True).alias("_known")).distinct()
    placed = issues.join(first, "review_id").join(known, ["review_id", "file"], "left")
    placed = placed.withColumn("file_path", F.when(F.col("_known"), F.col("file")).otherwise(F.col("_first")))
    lists = placed.groupBy("review_id", "file_path").agg(F.array_sort(F.collect_list(F.struct("ord", "severity", "type", "line", "message"))).alias("issues"))
    return entries.join(lists, ["review_id", "file_path"], "left").select("key", F.coalesce("issues", F.array().cast(lists.schema["issues"].dataType)).alias("issues"))


def latest(writes: DataFrame) -> DataFrame:
    """The last write of each key, a maximum that is combined before the shuffle; of equal times the one of the largest hash."""
    row = F.struct(*[F.col(c) for c in writes.columns])
    return writes.groupBy("key").agg(F.max_by(row, F.struct("written_at", F.xxhash64(*writes.columns))).alias("_m")).select("_m.*")
