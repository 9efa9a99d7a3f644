"""Blocked Bloom filters as tables, probed by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter that may be broadcast: 64 bytes of bits each, so 8 MB. ``split`` makes no larger filter.
BROADCAST_BLOCKS = 1 << 17
LANES = 8


def block_of(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1))


def _bit(key: Column, lane: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 6 * lane).bitwiseAND(F.lit(63)).cast("int")


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """A blocked Bloom filter as a table: ``_at`` and eight words of 64 bits; a key sets one bit in each."""
    at = [F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(key), i)) for i in range(LANES)]
    return listed.groupBy(block_of(F.col(key), blocks).alias("_at")).agg(*[F.bit_or(x).alias(f"_w{i}") for i, x in enumerate(at)])


def in_bloom(key: Column) -> Column:
    found = F.lit(True)
    for i in range(LANES):
        found = found & (F.call_function("shiftright", F.col(f"_w{i}"), _bit(key, i)).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(found, F.lit(False))


def blocks_for(keys: int) -> int:
    """The power of two of blocks that gives every key 16 bits or more."""
    blocks = 1
    while blocks * 512 < 16 * keys:
        blocks *= 2
    return blocks


def split(df: DataFrame, key: str, among: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` is surely not in the one column of ``among``, and the others.

    The filter never exceeds ``BROADCAST_BLOCKS``. Past that many keys it passes more rows than it
    need, which costs the later join time, never rows. Null keys are surely not among them.
    """
    listed = among.toDF("_key").where("_key is not null")
    blocks = min(BROADCAST_BLOCKS, blocks_for(listed.count()))
    bits = F.broadcast(bloom(listed, "_key", blocks))
    probed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df[key].alias("_key"))
    probed = probed.withColumn("_block", F.coalesce(block_of(F.col("_key"), blocks), F.lit(0)))
    probed = probed.join(bits, probed["_block"] == bits["_at"], "left").withColumn("_maybe", in_bloom(F.col("_key")) & F.col("_key").isNotNull())
    return probed.where(~F.col("_maybe")).select("_row.*"), probed.where("_maybe").select("_row.*")
