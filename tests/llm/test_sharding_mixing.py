from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import mixing, sharding
from reviewlens.llm.common import ranked

from .helpers import none, odd, words


def test_ranked_numbers_a_hot_group_in_order(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), "id", F.xxhash64("id").alias("h"))
    out = ranked(df, ["g"], ["id"], "r", "h", count="n", per_bucket=500).toPandas()
    for _, part in out.groupby("g"):
        part = part.assign(u=part.h.to_numpy("int64").view("uint64") >> np.uint64(1)).sort_values(["u", "id"])
        assert part.r.tolist() == list(range(len(part)))
        assert set(part.n) == {len(part)}


def test_shards_are_even_gapless_and_mixed(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "b").when(F.col("id") % 2 == 0, "c").alias("source"))
    out = sharding.interleave(df, 16).toPandas()
    sizes = out.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    mix = out.fillna({"source": "?"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 2
    again = sharding.interleave(df.repartition(7), 16).toPandas()
    assert dict(zip(out.doc_id, zip(out.shard, out.slot, strict=True), strict=True)) == dict(zip(again.doc_id, zip(again.shard, again.slot, strict=True), strict=True))


def test_sharding_odd_rows(spark):
    docs = odd(spark)
    out = sharding.interleave(docs, 5)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = out.collect()
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in docs.collect())
    assert sorted(Counter(r["shard"] for r in rows).values())[-1] - sorted(Counter(r["shard"] for r in rows).values())[0] <= 1
    assert sharding.interleave(none(spark), 5).count() == 0


def fill(caps, weights, total):
    """Shares by weight, excess over a cap dealt again, round by round."""
    got, open_ = dict.fromkeys(caps, 0.0), set(caps)
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w >= caps[s]}
        if not over:
            for s in open_:
                got[s] = left * weights[s] / w
            return got
        for s in over:
            got[s] = caps[s]
            left -= caps[s]
        open_ -= over
    return got


@pytest.mark.parametrize("share", [0.4, 1.5])
def test_mixture_meets_its_targets(spark, share):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "c", "é", "Z")]), (F.pow("id", 2) % 5 + 1).cast("int")).alias("source"), (1 + F.pmod(F.xxhash64("id"), F.lit(400))).alias("words"))
    df = df.withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("source")))
    out = mixing.mix(df, size="words", share=share).toPandas()
    by = out.assign(source=out.source.where(out.source.notna(), None), taken=out["size"] * out.copies).groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all() and out.copies.between(0, 2).all()
    names = sorted([s for s in by.index if isinstance(s, str)], key=lambda s: s.encode()) + [s for s in by.index if not isinstance(s, str)]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want = fill({s: 2.0 * by["size"][s] for s in names}, weights, share * by["size"].sum())
    for s in names:
        assert by.target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(by.taken[s] - by.target[s]) <= 401
    again = mixing.mix(df.repartition(5), size="words", share=share).toPandas()
    assert dict(zip(out.doc_id, out.copies, strict=True)) == dict(zip(again.doc_id, again.copies, strict=True))


def test_rates_are_exponential_in_size(spark):
    import math

    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), (1 + F.col("id") % 50).alias("words"))
    out = mixing.mix(df, size="words").toPandas()
    for _, part in out[out.rate.between(1e-6, 1.999)].groupby("source"):
        slope = part.rate.map(math.log) / part["size"]
        assert slope.max() - slope.min() < 1e-6


def test_mixing_odd_rows(spark):
    docs = odd(spark)
    out = mixing.mix(docs)
    rows = out.collect()
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in docs.collect())
    assert all(r["size"] == len(words(r["text"])) and 0 <= r["copies"] <= 2 for r in rows)
    assert "doc" in out.columns and out.columns.count("size") == 1
    assert mixing.mix(none(spark)).count() == 0
