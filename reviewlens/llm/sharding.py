"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import in_order, ranked


def interleave(docs: DataFrame, shards: int = 16, source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """Put every row into one of ``shards`` shards, each with the mixture of the whole.

    The rows of each source are shuffled by a seeded hash of ``key`` and ranked; a row's place is its
    rank as a fraction of its source; all rows, sorted by that place, are cut into runs whose lengths
    differ by at most one. Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in the shard).

    Null sources are a source of their own; null keys and repeated rows are dealt like any others;
    equal places, as all sources of one row have, are ordered by source, hash and key, and rows equal
    in these are interchangeable. The sort is by ranges of all four, so many small sources spread.
    An empty table gives an empty one. Columns named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[source].alias("_s"), docs[key].alias("_k"), F.xxhash64(F.lit(seed), docs[key]).alias("_h"))
    inside = ranked(rows, ["_s"], ["_k"], "_rank", "_h", count="_of")
    inside = inside.withColumn("_place", (F.col("_rank") + F.lit(0.5)) / F.col("_of"))
    whole = in_order(inside, ["_place", F.col("_s").asc_nulls_last(), "_h", "_k"], "_at")
    total = whole.count()
    whole = whole.withColumn("shard", F.expr(f"int((_at * {shards}) div {max(1, total)})"))
    return whole.select("_row.*", "shard", F.expr(f"_at - (shard * bigint({total}) + {shards - 1}) div {shards}").alias("slot"))
