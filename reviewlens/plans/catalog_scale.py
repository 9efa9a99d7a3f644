"""Queries of what works over many seeds, vectors, searches and streams at once; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import diff, graph, packing, retrieval
from reviewlens.plans import adapters as a
from reviewlens.plans import oracles_scale
from reviewlens.plans.catalog import ORACLE_SQL, QUERIES, _target, query
from reviewlens.sources.shared import written
from reviewlens.streaming import tasks

#: Seeds of the impact query, and queries of the vector search: every one whose number divides.
SEEDS, EVERY = 64, 20


@query
def hunk_split(spark, d):
    """PK3, PK4, W4: the parts of oversized diffs, with their contents."""
    e = a.diffs(spark, d).select("review_id", "ord", "file_path", F.col("diff_text").alias("content"), F.lit(0).alias("token_count"))
    return packing.split_oversized(e, 2000, 500).select("file_path", "part", "content", "token_count")


@query
def graph_impact_of_many(spark, d):
    """GR4, U2, U3: the parts within two calls of each of 64 parts."""
    e = a.part_edges(spark, d)
    seeds = e.select(F.col("dst").alias("id")).distinct().orderBy("id").limit(SEEDS)
    return graph.impact_of_many(e, seeds, 2)


@query
def graph_path(spark, d):
    """GR5: the shortest path itself, from both ends."""
    e = a.part_edges(spark, d)
    return graph.shortest_path(e, e.agg(F.min("src")).first()[0], _target(e)).select("step", "src", "dst", "type")


@query
def indexed_search_topk(spark, d):
    """RET6: the search of ``semantic_search_topk`` from a stored inverted index."""
    docs = a.table(spark, d, "documents")
    weights = written(retrieval.weighed(docs)[1], "weights")
    index = retrieval.TermIndex(weights)
    return index.search(weights.join(docs.agg(F.min("doc_id").alias("doc_id")), "doc_id"), 10).select("doc_id", F.round("score", 6).alias("score"))


@query
def vectors_topk_of_many(spark, d):
    """RET4, T1: the five nearest vectors of every twentieth vector."""
    v = a.table(spark, d, "embeddings")
    found = retrieval.VectorIndex(v).search(v.where(F.col("vec_id") % EVERY == 0), 5)
    return found.select("query", "nth", F.col("id").alias("vec_id"), F.round("score", 4).alias("score"))


def _stateful(spark, stream, name):
    """Runs a stream on the state store that keyed state and timers need; the session's own is put back."""
    setting, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, provider)
    try:
        return tasks.run_to_table(stream, name)
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


@query
def stream_dead_letters(spark, d):
    """ST2: messages that die by timer: events wait for ten minutes, and those of a purchase are taken at once."""
    e = tasks.stream_table(spark, d, "events.parquet", spark.read.parquet(f"{d}/events.parquet").schema)
    m = e.select(F.col("event_id").cast("string").alias("message_id"), "event_type", "ts", F.explode(F.when(F.col("event_type") == "purchase", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("taken"))
    dead = _stateful(spark, tasks.dead_letters(m, "event_type"), "dead")
    return dead.select(F.col("message_id").cast("long").alias("event_id"), "queue", F.unix_timestamp("died_at").alias("died_at"))


@query
def stream_conflicts(spark, d):
    """ST4: created, duplicate and conflicting requests as a stream."""
    e = tasks.stream_table(spark, d, "events.parquet", spark.read.parquet(f"{d}/events.parquet").schema)
    r = e.select(F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_type").alias("request_hash"), F.col("event_id").alias("ord"), "ts")
    # requests of all time count, as in the batch
    out = _stateful(spark, tasks.idempotent_stream(r, 10 * 365 * 24 * 60), "conflicts")
    return out.groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL |= {k: v for k, v in oracles_scale.SQL.items() if k in QUERIES}
