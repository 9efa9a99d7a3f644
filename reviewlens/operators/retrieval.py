"""Retrieval: vocabulary, TF-IDF weights, embeddings, cosine top-k."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.functions.text import code_tokens
from reviewlens.operators.facts import analyze, searchable, slices
from reviewlens.sources.shared import folder, spread, written

# Fixed values.
VOCABULARY, LEAST_FREQUENCY, SMALL_CORPUS, EMBED_BATCH = 512, 2, 10, 2048


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a row; named in a lambda as a column, the optimizer may put its whole expression there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG10 within the row: (``ident``, ``counts``): of each term of a document how often (``tf``) and of how many tokens (``len``).

    Tokens are sorted and runs of equal ones counted, so no (document, term) pair is ever shuffled.
    """

    def runs(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        entry = lambda s, k, a: F.struct(F.get(t, a).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - a).cast("long").alias("tf"), F.size(t).cast("long").alias("len"))
        return _let(starts, lambda s: F.transform(s, lambda a, k: entry(s, k, a)))

    return spread(docs.select(ident, text)).select(ident, _let(F.sort_array(code_tokens(F.coalesce(F.col(text), F.lit("")))), runs).alias("counts"))


def terms(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG10: (``ident``, ``term``, ``tf``, ``len``): a row for each document and term."""
    return exploded(counted(docs, ident, text), ident)


def exploded(counts: DataFrame, ident: str = "doc_id") -> DataFrame:
    """AGG10: a row for each document and term, of ``counted``."""
    return counts.select(ident, F.explode("counts").alias("c")).select(ident, "c.term", "c.tf", "c.len")


def vocabulary(tf: DataFrame, n_docs: int, size: int = VOCABULARY) -> DataFrame:
    """RET1, AGG9, T3: the ``size`` most frequent terms with their document and collection frequency, ties by term.

    Terms of a single occurrence count only in corpora of fewer than ten documents.
    """
    f = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    f = f if n_docs < SMALL_CORPUS else f.where(F.col("cf") >= LEAST_FREQUENCY)
    return f.orderBy(F.desc("cf"), "term").limit(size)


#: Terms of a vocabulary that may go into the plan of the weights.
MOST_TERMS = 4096


def weights(docs: DataFrame, vocab: DataFrame, n_docs: int, ident: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """RET2, AGG11: (``ident``, ``term``, ``weight``): tf / len * (ln((N + 1) / (df + 1)) + 1), of unit length for each document.

    The vocabulary, ``VOCABULARY`` rows unless asked for more and at most ``MOST_TERMS``, comes to the
    driver and goes into the plan as a literal; counting, weighing and the norm stay within a
    document's row, so this is one projection over the texts without a shuffle. ``counts``: what ``counted``
    gave of them, where it is written down.
    """
    known = {r["term"]: math.log((n_docs + 1) / (r["df"] + 1)) + 1 for r in vocab.select("term", "df").limit(MOST_TERMS + 1).collect()}
    if len(known) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    names = sorted(known)
    idf = F.map_from_arrays(F.array(*[F.lit(t) for t in names]).cast("array<string>"), F.array(*[F.lit(known[t]) for t in names]).cast("array<double>"))
    own = (counted(docs, ident, text) if counts is None else counts).select(ident, F.filter("counts", lambda c: c["term"].isin(names)).alias("counts"))
    raw = F.transform("counts", lambda c: F.struct(c["term"].alias("term"), (c["tf"] / c["len"] * F.element_at(idf, c["term"])).alias("w")))
    unit = lambda x: _let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e["w"] * e["w"])), lambda n: F.transform(x, lambda e: F.struct(e["term"].alias("term"), F.when(n > 0, e["w"] / n).otherwise(0.0).alias("weight"))))
    return own.select(ident, F.explode(_let(raw, unit)).alias("e")).select(ident, "e.term", "e.weight")


def weighed(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """RET1, RET2: the vocabulary of a corpus and its weights. Texts are cut into terms once; their counts are written down and read for both."""
    counts = written(counted(docs, ident, text), "counts")
    n = counts.count()
    vocab = vocabulary(exploded(counts, ident), n, size)
    return vocab, weights(docs, vocab, n, ident, text, counts)


class TermIndex:
    """RET6, RET7: an inverted index in blocks, searched without reading what can't be among the best.

    Documents are put in order of their strongest term and its weight and cut into blocks of ``BLOCK``; a
    row of the stored table holds a term's postings within a block, with their greatest weight. A block's
    score can't pass the sum of the query's weights times these. A search reads the bounds, a narrow column;
    then the postings of the few blocks of the highest bounds, whose k-th score is a floor; then those
    of the blocks whose bound reaches the floor. All others are skipped, so the answer is exact.
    """

    BLOCK, FIRST = 256, 8
    #: What rounding of sums may hide of a score.
    SLACK = 1e-8

    def __init__(self, weights: DataFrame, ident: str = "doc_id", path: str | None = None):
        self.ident, self.spark = ident, weights.sparkSession
        self.path = path or folder(self.spark, "postings")
        strongest = weights.groupBy(ident).agg(F.max(F.struct("weight", "term")).alias("top"))
        # places follow a sort by ranges: within a range rows are numbered by their partition alone
        placed = strongest.repartitionByRange("top.term", "top.weight", ident).sortWithinPartitions("top.term", "top.weight", ident)
        place = F.monotonically_increasing_id()
        placed = written(placed.select(ident, (F.shiftright(place, 33) * (1 << 25) + F.floor(place % (1 << 33) / self.BLOCK)).cast("long").alias("block")), "places")
        rows = weights.join(placed, ident).groupBy("term", "block").agg(F.collect_list(F.struct(F.col(ident).alias("id"), "weight")).alias("postings"), F.max("weight").alias("most"))
        rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(self.path)
        self.table = self.spark.read.schema(rows.schema).parquet(self.path)

    def search(self, query: DataFrame, k: int) -> DataFrame:
        """The ``k`` documents of the highest cosine with ``query`` (``term``, ``weight``), as ``search_terms`` gives them."""
        k = max(1, k)
        wanted = {r["term"]: r["weight"] for r in query.select("term", "weight").limit(MOST_TERMS + 1).collect()}
        if len(wanted) > MOST_TERMS:
            raise ValueError(f"a query of more than {MOST_TERMS} terms")
        if not wanted:
            return self.table.select(F.explode("postings").alias("p")).select(F.col("p.id").alias(self.ident), F.col("p.weight").alias("score")).limit(0)
        mine = self.table.where(F.col("term").isin(sorted(wanted)))
        q = F.element_at(F.create_map(*[x for t in sorted(wanted) for x in (F.lit(t), F.lit(float(wanted[t])))]), F.col("term"))
        # a negative weight would lower a bound, so it counts as none
        bounds = mine.groupBy("block").agg(F.sum(F.greatest(q * F.col("most"), F.lit(0.0))).alias("bound"))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(self.FIRST).collect()]

        def scores(rows: DataFrame) -> DataFrame:
            hits = rows.select(F.explode("postings").alias("p"), q.alias("q"))
            return hits.groupBy(F.col("p.id").alias(self.ident)).agg(F.sum(F.col("p.weight") * F.col("q")).alias("score"))

        best = scores(mine.where(F.col("block").isin(first))).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).first()
        floor = best["floor"] - self.SLACK if best["n"] == k else None
        self.left = bounds if floor is None else bounds.where((F.col("bound") >= floor) | F.col("block").isin(first))
        self.asked = mine
        return scores(mine.join(self.left.select("block"), "block", "left_semi")).orderBy(F.desc(F.round("score", 9)), self.ident).limit(k)

    def reads(self) -> tuple[int, int]:
        """Postings of the last search's terms that it read to the end, and how many there are."""
        size = F.sum(F.size("postings"))
        read = self.asked.join(self.left.select("block"), "block", "left_semi").agg(size).first()[0]
        return read or 0, self.asked.agg(size).first()[0] or 0


class VectorIndex:
    """RET4, T1 for many queries: vectors in clusters with radii, exact by Cauchy and Schwarz.

    Centres are the first vectors by hash, as many as the root of all, up to ``CENTRES``: a bounded sample, which
    decides speed alone. Every vector goes to its
    nearest centre; clusters are cut into cells of about ``CELL`` vectors by hash, so that copies of one
    vector fill many cells, each with the largest distance of its vectors from the centre. For a query q no
    vector of a cell scores more than q * centre + |q| * radius. A query's best cells give its k-th score so
    far, a floor; then it meets the cells whose bound reaches that. Queries and cells meet in blocks; a
    block hands on at most k rows a query.
    """

    CENTRES, CELL, QUERIES, FIRST = 1024, 4096, 1024, 2
    SLACK = 1e-7

    def __init__(self, vectors: DataFrame, ident: str = "vec_id", embedding: str = "embedding"):
        self.spark = vectors.sparkSession
        rows = vectors.where(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull())).select(F.col(ident).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
        picked = rows.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(max(1, min(self.CENTRES, math.isqrt(rows.count())))).collect()
        self.centres: dict[int, np.ndarray] = {}
        for r in picked:
            self.centres.setdefault(len(r["v"]), []).append(r["v"])
        self.centres = {n: np.array(c, np.float64).reshape(len(c), n) for n, c in self.centres.items()}
        centres = self.centres

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                size = f["v"].map(len)
                for n, part in f.groupby(size):
                    x, c = np.stack(part["v"].to_numpy()).reshape(len(part), n), centres.get(n, np.zeros((1, n)))
                    far = ((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)).clip(0)
                    near = far.argmin(axis=1)
                    yield pd.DataFrame({"id": part["id"], "v": part["v"], "dims": int(n), "centre": near, "far": np.sqrt(((x - c[near]) ** 2).sum(axis=1))})

        placed = written(rows.mapInPandas(place, "id long, v array<double>, dims int, centre long, far double"), "placed")
        sizes = placed.groupBy("dims", "centre").agg(F.ceil(F.count(F.lit(1)) / self.CELL).alias("cells"))
        # at most a row for each centre
        cut = placed.join(F.broadcast(sizes), ["dims", "centre"]).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells"))).drop("cells")
        self.table = written(cut, "cells")
        self.radii = written(self.table.groupBy("dims", "centre", "cell").agg(F.max("far").alias("radius")), "radii")

    def _meet(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of each query in the cells that ``pairs`` (``query``, ``dims``, ``centre``, ``cell``) names."""
        asked = pairs.join(queries, "query").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(self.parts)))
        key = ["dims", "centre", "cell", "part"]
        # other names for the same columns, as both sides meet again below
        parts = asked.select(*[F.col(c).alias(c) for c in key]).distinct()
        cells = self.table.join(parts, key[:3]).select(*[F.col(c).alias(c) for c in key], "id", "v")

        def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return pd.DataFrame({"query": [], "id": [], "score": []})
            score = np.stack(q["q"].to_numpy()) @ np.stack(c["v"].to_numpy()).T
            score, ids = score.reshape(len(q), len(c)), c["id"].to_numpy()
            # all queries at once: what reaches each one's k-th score, in order, and of that the first k
            nice = score.round(9)
            reach = nice >= np.partition(nice, -k, axis=1)[:, -k:][:, :1] if len(c) > k else np.ones(nice.shape, bool)
            row, col = np.nonzero(reach)
            order = np.lexsort((ids[col], -nice[row, col], row))
            row, col = row[order], col[order]
            row_at = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[row_at < k], col[row_at < k]
            return pd.DataFrame({"query": q["query"].to_numpy()[row], "id": ids[col], "score": score[row, col]})

        found = asked.groupBy(*key).cogroup(cells.groupBy(*key)).applyInPandas(best, "query long, id long, score double")
        return self._top(found, k)

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        # Spark keeps k rows of a query in each task before the shuffle
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id"))
        return found.withColumn("nth", nth).where(F.col("nth") <= k)

    def search(self, queries: DataFrame, k: int, ident: str = "vec_id", embedding: str = "embedding") -> DataFrame:
        """(``query``, ``nth``, ``id``, ``score``): the ``k`` nearest vectors of its length of each query, by falling score, then id."""
        k = max(1, k)
        q = written(queries.where(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull())).select(F.col(ident).cast("long").alias("query"), F.col(embedding).cast("array<double>").alias("q")), "queries")
        self.parts = max(1, -(-q.count() // self.QUERIES))
        centres = self.centres

        def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for n, part in f.groupby(f["q"].map(len)):
                    x, c = np.stack(part["q"].to_numpy()).reshape(len(part), n), centres.get(n, np.zeros((1, n)))
                    dots, m = x @ c.T, len(c)
                    yield pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), m), "dims": int(n), "centre": np.tile(np.arange(m), len(part)), "dot": dots.ravel(), "length": np.repeat(np.sqrt((x * x).sum(axis=1)), m)})

        each = q.mapInPandas(bound, "query long, dims int, centre long, dot double, length double").join(self.radii, ["dims", "centre"])
        self.bounds = written(each.select("query", "dims", "centre", "cell", (F.col("dot") + F.col("length") * F.col("radius")).alias("bound"), F.col("dot")), "bounds")
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dot"), "centre", "cell"))
        near = self.bounds.withColumn("_n", order).where(F.col("_n") <= self.FIRST)
        first = written(self._meet(near.drop("_n", "bound", "dot"), q, k), "first")
        floor = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        left = self.bounds.join(floor, "query", "left").join(near.select("query", "dims", "centre", "cell"), ["query", "dims", "centre", "cell"], "left_anti")
        self.left = written(left.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - self.SLACK)).select("query", "dims", "centre", "cell"), "left")
        more = self._meet(self.left, q, k)
        return self._top(first.drop("nth").unionByName(more.drop("nth")), k).select("query", "nth", "id", "score")


def index_project(files: DataFrame, size: int = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RET5: a project's files (``file_path``, ``content``) to its chunks by method, type and file, their vocabulary and weights.

    Chunks of one id, as equal classes of two files give, are told apart by their path. The parts are
    written down before what reads them twice; ``search_terms`` and ``related`` answer from the weights.
    """
    found = written(analyze(files), "facts")
    chunks = searchable(slices(files, found)).withColumn("chunk_id", F.concat_ws("@", "chunk_id", "file_path"))
    chunks = written(chunks, "chunks")
    return chunks, *weighed(chunks, "chunk_id", size=size)


def search_terms(index: DataFrame, query: DataFrame, k: int, ident: str = "doc_id") -> DataFrame:
    """RET6, T1 over sparse weights: the ``k`` documents of the highest cosine with ``query`` (``term``, ``weight``); none without shared terms.

    Only postings of the query's terms meet, as many as a vocabulary has at most, so the query is broadcast.
    """
    q = F.broadcast(query.select("term", F.col("weight").alias("q")))
    hits = index.join(q, "term").groupBy(ident).agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
    return hits.orderBy(F.desc(F.round("score", 9)), ident).limit(max(1, k))


def cosine(a: Column, b: Column) -> Column:
    """RET4: the dot product, 0 where the lengths differ; vectors are of unit length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(F.lit(0.0))


def search_vectors(vectors: DataFrame, query: list[float], k: int, ident: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """RET6, T1: the ``k`` nearest vectors; a projection and a bounded top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(ident, cosine(F.col(embedding), q).alias("score")).orderBy(F.desc(F.round("score", 9)), ident).limit(max(1, k))


def related(index: DataFrame, chunks: DataFrame, query: DataFrame, own_path: str, k: int, ident: str = "chunk_id") -> DataFrame:
    """RET7, T5, JN13: twice as many hits as asked, without those of the own file, cut to ``k``; hits without a chunk drop."""
    hits = search_terms(index, query, 2 * max(1, k), ident).join(chunks, ident)
    return hits.where(F.col("file_path") != own_path).orderBy(F.desc(F.round("score", 9)), ident).limit(max(1, k))


def embed(docs: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], ident: str = "chunk_id", text: str = "text", batch: int = EMBED_BATCH) -> DataFrame:
    """RET3: an injected function over batches; a batch that fails gives null vectors and its error, never an exception."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                try:
                    vectors, error = embed_fn(part[text].tolist()), None
                except Exception as e:  # noqa: BLE001  what the boundary raises is data here
                    vectors, error = [None] * len(part), str(e)
                yield pd.DataFrame({ident: part[ident].tolist(), "embedding": vectors, "error": [error] * len(part)})

    return docs.select(ident, text).mapInPandas(run, f"{ident} {kind}, embedding array<float>, error string")


def preview(content: Column, lines: int = 5) -> Column:
    """The first lines, and how many more there are."""
    parts = F.split(content, "\n")
    more = F.size(parts) - lines
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n... ("), more, F.lit(" more)"))).otherwise(content)
