"""Issue algebra: counts, deduplication, ranking, routing, merging of chunk results, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.functions import severity as sev
from reviewlens.functions.text import message_key
from reviewlens.operators.filters import excluded

# Fixed values.
REVIEWERS = ("security", "logic", "quality")
SECURITY_WORDS = ("sql", "xss", "csrf", "injection", "auth", "secret", "hardcoded")
LOGIC_WORDS = ("null", "race", "resource", "leak", "overflow", "concurrency", "logic")
MOST_ISSUES, MOST_A_REVIEWER, MOST_SECTION = 50, 15, 8000
FAILED_RATIO = 0.5


def severity_counts(issues: DataFrame, *keys: str) -> DataFrame:
    """AGG1, AGG2: counts by severity, all three in columns, and whether any is critical."""
    s = F.col("severity")
    counts = [F.count_if(s == x).alias(x.lower()) for x in sev.SEVERITIES]
    return issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts, F.coalesce(F.bool_or(s == "CRITICAL"), F.lit(False)).alias("has_critical"))


def severity_report(issues: DataFrame) -> DataFrame:
    """AGG1 over the enumeration: a row for every severity, found or not."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(s, k) for k, s in enumerate(sev.SEVERITIES)], "severity string, ord int")
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    return every.join(counts, "severity", "left").select("ord", "severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("files", F.lit(0)).alias("files"))


def identity(file: Column, type_: Column, line: Column, message: Column, suggestion: Column) -> Column:
    """An issue's fingerprint: with a line, file, type, line and message; without, the suggestion instead of the line."""
    placed = F.coalesce(line, F.lit(-1)) >= 0
    return F.struct(
        F.trim(F.coalesce(file, F.lit(""))).alias("file"),
        F.lower(F.trim(F.coalesce(type_, F.lit("")))).alias("type"),
        F.when(placed, line).otherwise(-1).alias("line"),
        message_key(message).alias("message"),
        F.when(placed, F.lit("")).otherwise(message_key(suggestion)).alias("suggestion"),
    )


def deduplicate(issues: DataFrame, order: str = "ord", keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG5: of equal issues the one of the highest severity, the earliest on ties, at the first one's place.

    One aggregation with partial maxima of (rank, -order, row), so a fingerprint that a third of the
    rows share is combined before the shuffle; no window gathers its rows.
    """
    kept = [c for c in issues.columns if c != order]
    row = F.struct(sev.rank(F.col("severity")).alias("r"), (-F.col(order)).alias("o"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)])
    key = identity(F.col("file"), F.col("type"), F.col("line"), F.col("message"), F.col("suggestion"))
    best = issues.groupBy(*keys, key.alias("_key")).agg(F.max_by(row, F.struct(sev.rank(F.col("severity")), -F.col(order))).alias("_m"), F.min(order).alias("_first"))
    return best.select(F.col("_first").alias(order), *[F.col(f"_m.c{k}").alias(c) for k, c in enumerate(kept)])


def top_issues(issues: DataFrame, most: int = MOST_ISSUES, each: int = MOST_A_REVIEWER) -> DataFrame:
    """The heaviest ``most`` by severity, ties by order, then ``each`` of every reviewer.

    The first cut is a top-k that needs no full sort; the second ranks at most ``most`` rows.
    """
    w = sev.weight(F.col("severity"))
    top = issues.withColumn("weight", w).orderBy(F.desc("weight"), "ord").limit(most)
    nth = F.row_number().over(Window.partitionBy("reviewer").orderBy(F.desc("weight"), "ord"))
    return top.withColumn("nth", nth).where(F.col("nth") <= each)


def reviewer_sections(issues: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each review's text of its top issues by reviewer, as JSON, cut to ``MOST_SECTION`` characters.

    ``issues`` as from ``top_issues``; ``summaries`` (``reviewer``, ``nth_reviewer``, ``summary``) gives the order.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.struct("severity", "file", "line", "type", "message").alias("i")))), lambda x: x["i"])
    by = summaries.join(issues.groupBy("reviewer").agg(listed.alias("issues")), "reviewer", "left")
    empty = F.array().cast(by.schema["issues"].dataType)
    found = F.coalesce("issues", empty)
    text = F.concat(F.lit("\n["), "reviewer", F.lit("]"), F.to_json(F.struct("summary", F.size(found).alias("issue_count"), found.alias("issues"))), F.lit("\n"))
    whole = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth_reviewer", text.alias("t")))), lambda x: x["t"]), "").alias("section"))
    return whole.select(F.when(F.length("section") > MOST_SECTION, F.concat(F.left("section", F.lit(MOST_SECTION)), F.lit("\n...(truncated)"))).otherwise(F.col("section")).alias("section"))


def guess_reviewer(type_: Column, message: Column) -> Column:
    """The reviewer whose words stand in type or message."""
    text = F.concat_ws("\n", F.lower(F.coalesce(type_, F.lit(""))), F.lower(F.coalesce(message, F.lit(""))))
    any_of = lambda words: F.exists(F.array(*[F.lit(x) for x in words]), lambda x: F.contains(text, x))
    return F.when(any_of(SECURITY_WORDS), "security").when(any_of(LOGIC_WORDS), "logic").otherwise("quality")


def route_files(focus: DataFrame, files: DataFrame) -> DataFrame:
    """JN14: ``focus`` (``review_id``, ``ord``, ``key``, ``paths``), ``files`` (``review_id``, ``path``) to (review, reviewer, path).

    Keys are mapped by what they contain; of several keys for a reviewer the last one's list counts,
    while what any of them lists is assigned; unassigned files go to every reviewer.
    """
    k = F.lower("key")
    named = focus.withColumn("reviewer", F.when(k.contains("sec"), "security").when(k.contains("log"), "logic").when(k.contains("qual"), "quality"))
    named = named.where("reviewer is not null and size(paths) > 0")
    listed = named.select("review_id", "reviewer", "ord", F.explode("paths").alias("path")).join(files, ["review_id", "path"], "left_semi")
    last = named.groupBy("review_id", "reviewer").agg(F.max("ord").alias("ord"))
    chosen = listed.join(last, ["review_id", "reviewer", "ord"], "left_semi").select("review_id", "reviewer", "path")
    rest = files.join(listed.select("review_id", "path").distinct(), ["review_id", "path"], "left_anti")
    all_of = rest.withColumn("reviewer", F.explode(F.array(*[F.lit(r) for r in REVIEWERS]))).select("review_id", "reviewer", "path")
    return chosen.unionByName(all_of)


def merge_chunks(chunks: DataFrame, most_failed: float = FAILED_RATIO) -> DataFrame:
    """AGG16, AGG17: a review's outcome from its chunks (``review_id``, ``ord``, ``summary``, ``has_critical``, ``used_fallback``, ``error``)."""
    failed = F.col("error").isNotNull()
    parts = F.transform(F.array_sort(F.collect_list(F.when(~failed & (F.coalesce("summary", F.lit("")) != ""), F.struct("ord", "summary")))), lambda x: x["summary"])
    out = chunks.groupBy("review_id").agg(
        F.count(F.lit(1)).cast("int").alias("chunks"),
        F.count_if(failed).cast("int").alias("failed"),
        F.coalesce(F.bool_or("used_fallback"), F.lit(False)).alias("fallback"),
        F.coalesce(F.bool_or("has_critical"), F.lit(False)).alias("has_critical"),
        parts.alias("parts"),
    )
    merged = F.when(F.size("parts") == 0, F.concat(F.lit("Reviewed changes across "), F.col("chunks"), F.lit(" batches."))).when(F.size("parts") == 1, F.col("parts")[0]).otherwise(
        F.concat(F.lit("["), F.col("chunks"), F.lit("-batch review] "), F.array_join("parts", " | "))
    )
    ratio = F.col("failed") / F.col("chunks")
    status = F.when((F.col("failed") == F.col("chunks")) | (ratio > most_failed), "FAILED").when(F.col("failed") > 0, "PARTIAL").otherwise("COMPLETED")
    prefix = F.concat(F.when(F.col("failed") > 0, F.concat(F.lit("[partial "), F.col("chunks") - F.col("failed"), F.lit("/"), F.col("chunks"), F.lit("] "))).otherwise(""), F.when(F.col("fallback"), "[fallback] ").otherwise(""))
    return out.select("review_id", "chunks", "failed", "has_critical", status.alias("status"), F.concat(prefix, merged).alias("summary"))


def merge_batches(results: DataFrame) -> DataFrame:
    """AGG15: files summed, critical flags OR-ed, raw reports joined, issues concatenated in batch order."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", c)))), lambda x: x[c])
    return results.groupBy("review_id").agg(F.sum("files").alias("files"), F.bool_or("has_critical").alias("has_critical"), F.array_join(ordered("raw"), "\n\n").alias("raw"), F.flatten(ordered("issues")).alias("issues"))


def token_usage(calls: DataFrame) -> DataFrame:
    """AGG18: sums by run of usage in JSON (``llm_output``, ``generation_info``, ``usage_metadata``), the first that has any, under any provider's names."""
    first = lambda j, *paths: F.coalesce(*[F.nullif(F.try_variant_get(j, p, "bigint"), F.lit(0)) for p in paths], F.lit(0))
    outputs = []
    for column, paths in (("llm_output", ("$.token_usage", "$.usage")), ("generation_info", ("$.usage", "$.token_usage")), ("usage_metadata", ("$",))):
        j = F.try_parse_json(F.col(column))
        outputs += [F.nullif(F.nullif(F.try_variant_get(j, p, "string"), F.lit("{}")), F.lit("null")) for p in paths]
    used = calls.withColumn("_u", F.try_parse_json(F.coalesce(*outputs)))
    u = F.col("_u")
    prompt = first(u, "$.prompt_tokens", "$.input_tokens", "$.prompt_token_count")
    completion = first(u, "$.completion_tokens", "$.output_tokens", "$.candidate_tokens")
    total = first(u, "$.total_tokens", "$.total_token_count")
    used = used.withColumns({"_p": prompt, "_c": completion}).withColumn("_t", F.when(total > 0, total).otherwise(F.col("_p") + F.col("_c")))
    return used.groupBy("run_id").agg(F.sum("_p").alias("prompt_tokens"), F.sum("_c").alias("completion_tokens"), F.sum("_t").alias("total_tokens"), F.count(F.lit(1)).alias("calls"))


def comments(issues: DataFrame, files: DataFrame) -> DataFrame:
    """SNK1, SNK2, JN2: inline comments of visible issues in the review's files; a missing line, or 0, is 1."""
    seen = issues.where(~excluded()) if "filter_metadata" in issues.columns else issues
    shown = seen.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    suggestion = F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("\n\n> **Suggestion**: "), "suggestion")).otherwise("")
    body = F.concat(F.lit("**["), "severity", F.lit("] "), "type", F.lit("**: "), "message", suggestion)
    return shown.select("ord", F.col("file").alias("path"), F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.lit(1)).cast("int").alias("line"), F.lit("RIGHT").alias("side"), body.alias("body"))


def summary_comment(issues: DataFrame) -> DataFrame:
    """SNK2: one row: the summary of the visible issues."""
    seen = issues.where(~excluded()) if "filter_metadata" in issues.columns else issues
    c = seen.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in sev.SEVERITIES])
    part = lambda s, name: F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {name}")))
    found = F.concat_ws(" ", F.concat(F.lit("Found **"), F.col("n"), F.lit("** findings:")), part("CRITICAL", "Critical"), part("WARNING", "Warning"), part("INFO", "Info"))
    return c.select(F.when(F.col("n") == 0, "No actionable findings, safe to merge.").otherwise(found).alias("summary"))


def totals(entries: DataFrame) -> DataFrame:
    """AGG20: files, lines (0 for empty content) and tokens of the entries of each review."""
    lines = F.when(F.coalesce("content", F.lit("")) == "", 0).otherwise(F.size(F.split("content", "\n")))
    return entries.groupBy("review_id").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"), F.sum("token_count").alias("tokens"))


def parse_error_text(errors: DataFrame) -> DataFrame:
    """AGG21: the first three errors of each file, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "error"))), lambda x: x["error"])
    return errors.groupBy("file_path").agg(F.array_join(F.slice(ordered, 1, 3), "; ").alias("parse_error"))


def severity_maps(issues: DataFrame) -> DataFrame:
    """§2.9 maps: for each review its counts by severity, as a map that holds the severities it has."""
    by = issues.groupBy("review_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("review_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("counts"))


def merged_maps(first: Column, second: Column) -> Column:
    """§2.9 maps: two maps of counts added up."""
    total = F.map_zip_with(F.coalesce(first, F.create_map().cast("map<string,bigint>")), F.coalesce(second, F.create_map().cast("map<string,bigint>")), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return total


def cube_severity_type(issues: DataFrame) -> DataFrame:
    """Extension: counts over every combination of severity and type, with totals."""
    return issues.cube("severity", "type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
