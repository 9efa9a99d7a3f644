"""Context text for a diff from code facts, within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import estimated_tokens
from reviewlens.operators.facts import callees_text, of_kind

# Fixed values.
SHARE, MOST, LEAST = 0.2, 600, 50


def budget(diff_tokens: Column) -> Column:
    """CH4: a fifth of the diff's tokens, at most 600; none under 50."""
    b = F.least((diff_tokens * SHARE).cast("int"), F.lit(MOST))
    return F.when(b >= LEAST, b).otherwise(0)


def contexts(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """Three texts for each file, full, without calls, and only what changed: (``file_path``, ``full``, ``middle``, ``least``).

    ``changed``: (``file_path``, ``file_line``). Methods that hold a changed line come first (T4).
    """
    lists = changed.groupBy("file_path").agg(F.collect_set("file_line").alias("lines"))
    methods = of_kind(facts, "method").select("file_path", "owner", "name", "names", F.col("type").alias("returns"), "detail", "start_line", "end_line", "ord")
    called = callees_text(facts).select("file_path", "owner", F.col("caller").alias("name"), "callees")
    m = methods.join(lists, "file_path", "left").join(called, ["file_path", "owner", "name"], "left")
    hit = F.coalesce(F.exists("lines", lambda x: x.between(F.col("start_line"), F.col("end_line"))), F.lit(True))
    head = F.concat(F.lit("  "), "detail", F.lit(" "), "returns", F.lit(" "), "name", F.lit("("), F.array_join("names", ", "), F.lit(")"), F.lit(" lines "), "start_line", F.lit("-"), "end_line")
    m = m.withColumn("hit", hit).withColumn("head", head).withColumn("tail", F.when(F.col("callees").isNotNull(), F.concat(F.lit(" calls "), "callees")).otherwise(""))
    ordered = lambda cond, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct((~F.col("hit")).alias("a"), F.col("start_line").alias("b"), F.col("ord").alias("c"), what.alias("x"))))), lambda x: x["x"]), "\n")
    every = F.lit(True)
    texts = m.groupBy("file_path").agg(ordered(every, F.concat("head", "tail")).alias("f"), ordered(every, F.col("head")).alias("m"), ordered(F.col("hit"), F.col("head")).alias("l"))
    types = of_kind(facts, "type").groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat("type", F.lit(" "), "name").alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    out = types.join(texts, "file_path", "left")
    return out.select("file_path", *[F.concat_ws("\n", "t", c).alias(name) for c, name in (("f", "full"), ("m", "middle"), ("l", "least"))])


def enrich(entries: DataFrame, context: DataFrame) -> DataFrame:
    """CH4, CH5: the longest of a file's three texts within the budget, put before its diff; tokens are counted anew.

    Line numbers of the raw diff would shift, so scans take the entries as they were before this.
    """
    b = budget(F.col("token_count"))
    fits = lambda c: F.col(c).isNotNull() & (estimated_tokens(F.col(c)) <= b)
    out = entries.join(context, "file_path", "left")
    chosen = F.when(fits("full"), F.col("full")).when(fits("middle"), F.col("middle")).when(fits("least"), F.col("least")).otherwise("")
    out = out.withColumn("context", chosen).withColumn("content", F.when(F.col("context") != "", F.concat("context", F.lit("\n\n"), "content")).otherwise(F.col("content")))
    return out.withColumn("token_count", F.when(F.col("context") != "", estimated_tokens(F.col("content"))).otherwise(F.col("token_count"))).drop("full", "middle", "least")
