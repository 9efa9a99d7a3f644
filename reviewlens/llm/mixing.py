"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm.common import BROADCAST_ROWS, in_order, keep, n_words, ranked, small

#: No document is taken more often.
MOST_COPIES = 2


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with ``target``: weighted shares of ``share`` times all sizes.

    The weights repeat over the sources in code point order, null last. A target stops at twice its
    source's size and the excess is shared anew by weight, until none is above: the level at which
    the capped targets sum to the whole is the highest that the sources, by cap per weight, reach.
    One row for each source, sorted by ranges twice, so that millions of sources (hosts) spread too.
    """
    each = F.array(*[F.lit(float(w)) for w in weights])
    out = in_order(sources, [F.col("source").asc_nulls_last()], "_nth")
    out = out.withColumn("_w", F.element_at(each, (F.pmod("_nth", F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * float(MOST_COPIES))
    out = in_order(out, [F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()], "_nth", {"_caps": F.col("_cap"), "_ws": F.col("_w")})
    size, weight = out.agg(F.sum("source_size"), F.sum("_w")).first()
    left = F.col("_ws") * -1.0 + (weight or 0.0)
    level = out.agg(F.max(((size or 0) * share - F.col("_caps")) / left)).first()[0]
    return out.withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("_cap"), F.lit(level) * F.col("_w")))).drop("_w", "_cap", "_caps", "_ws", "_nth")


def balance(cells: DataFrame, sources: DataFrame, close: float = 1e-9) -> DataFrame:
    """Solve for each source's ``lam``: its documents' rates min(2, exp(lam * size / mean size)) take ``target`` words.

    ``cells``: ``source``, ``size`` and ``n``, the number of its documents of that size. The rates are
    those nearest to 1 in relative entropy, at most 2, that meet the constraint; ``lam`` is the dual
    variable. Each iteration is one distributed aggregation of the dual's gradient and curvature over
    the cells, and one Newton step for every source, halved into its bracket where it would leave it;
    they go on until all sources are solved. ``lam`` is given to 12 digits, which sums in another order
    don't change.
    Sources without words have rate 1 and take nothing; a target of 0 has rate 0.
    """
    moments = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("_a"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("_mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_least"))
    state = sources.join(moments.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    small_x = F.col("_least") / F.col("_mean")
    top = F.lit(math.log(MOST_COPIES)) / small_x
    state = state.withColumns(
        {
            "hi": F.coalesce(top, F.lit(0.0)),
            "lo": F.when((F.col("target") > 0) & (F.col("_a") > 0), F.least(F.lit(-1e-9), F.log(F.col("target") / F.col("_a")) / small_x)).otherwise(F.lit(0.0)),
            "done": (F.col("_a") == 0) | (F.col("target") <= 0) | (F.col("target") >= F.col("_a") * MOST_COPIES * (1 - 1e-12)),
        }
    )
    start = F.when(F.col("_a") == 0, F.lit(0.0)).when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("done"), F.col("hi")).otherwise(F.lit(0.0))
    state = keep(state.withColumn("lam", start))
    files = 1 + state.count() // 1_000_000  # a row for each source: few files an iteration
    while True:
        x = F.col("size") / F.col("_mean")
        rate = F.least(F.lit(float(MOST_COPIES)), F.exp(F.col("lam") * x))
        here = small(state.select(F.col("source").alias("_src"), "lam", "_mean", "done"), BROADCAST_ROWS)
        joined = cells.join(here, cells["source"].eqNullSafe(F.col("_src")) & ~F.col("done"))
        mass = F.col("n") * F.col("size")
        sums = joined.groupBy("_src").agg(F.sum(mass * rate).alias("_f"), F.sum(F.when(rate < MOST_COPIES, mass * x * rate).otherwise(0.0)).alias("_df"))
        state = state.join(sums, state["source"].eqNullSafe(F.col("_src")), "left").drop("_src")
        miss = F.col("_f") - F.col("target")
        state = state.withColumns({"lo": F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") - miss / F.col("_df")
        inside = (F.col("_df") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        over = F.col("done") | (F.abs(miss) <= close * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-15 * F.abs(F.col("lam")))
        state = state.withColumns({"done": over, "lam": F.when(over, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)})
        state = keep(state.drop("_f", "_df").coalesce(files))
        if not state.where(~F.col("done")).limit(1).count():
            break
    # 12 digits: far finer than a word, far coarser than what the order of a sum moves
    return state.withColumn("lam", F.when(F.abs("lam") < float("inf"), F.format_string("%.11e", "lam").cast("double")).otherwise(F.col("lam")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, source: str = "source", key: str = "doc_id", text: str = "text", size: str | None = None, seed: int = 29) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (0 to 2) to every row.

    ``size`` is the words of ``text`` (null: 0) or the column named. The rates are rounded by
    systematic sampling within each source, over the documents in order of size and of a seeded hash
    of ``key``: the copies of any run differ from its rates' sum by less than one, so a source takes
    its target to within about its longest document. Reruns agree; rows equal in source, size and
    key are interchangeable. Null sources are one source; null keys and empty texts are dealt like
    others; an empty table gives an empty one. Columns with the added names are replaced.
    """
    own = n_words(docs[text]) if size is None else docs[size].cast("long")
    columns = [docs[c] for c in docs.columns if c.lower() not in {"size", "source_size", "target", "rate", "copies"}]
    docs = docs.select(F.struct(*columns).alias("_row"), docs[source].alias("_s"), docs[key].alias("_k"), own.alias("size"))
    docs = docs.withColumn("_h", F.xxhash64(F.lit(seed), "_k", "size"))
    cells = keep(docs.groupBy(F.col("_s").alias("source"), "size").agg(F.count(F.lit(1)).alias("n")))
    sources = keep(targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share))
    solved = balance(cells, sources).select(F.col("source").alias("_src"), "source_size", "target", "lam", "_mean")
    on = cells["source"].eqNullSafe(F.col("_src"))
    # no words: nothing to take, at any rate
    rate = F.when(F.col("size") == 0, F.least(F.lit(1.0), F.exp("lam"))).otherwise(F.least(F.lit(float(MOST_COPIES)), F.exp(F.col("lam") * F.col("size") / F.col("_mean"))))
    rated = cells.join(small(solved, BROADCAST_ROWS), on).withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("_part", F.col("rate") - F.floor("rate"))
    before = F.sum(F.col("n") * F.col("_part")).over(Window.partitionBy("_src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    rated = small(rated.withColumn("_before", F.coalesce(before, F.lit(0.0)) + 0.5).select("_src", F.col("size").alias("_size"), "source_size", "target", "rate", "_part", "_before"), BROADCAST_ROWS)
    placed = ranked(docs, ["_s", "size"], ["_k"], "_at", "_h")
    out = placed.join(rated, placed["_s"].eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_size")))
    extra = F.floor(F.col("_before") + (F.col("_at") + 1) * F.col("_part")) - F.floor(F.col("_before") + F.col("_at") * F.col("_part"))
    out = out.withColumn("copies", F.least(F.lit(MOST_COPIES), F.floor("rate") + extra).cast("int"))
    return out.select("_row.*", "size", "source_size", "target", "rate", "copies")
