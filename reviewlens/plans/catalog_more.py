"""More of the catalogue: sources, boundaries, tools, every rule and pattern, and the literal project."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from reviewlens.functions.text import basename, duration, fill, neutral, provider_tokens
from reviewlens.operators import diff, facts, filters, graph, issues, packing, report, retrieval, rules, tools
from reviewlens.plans import adapters as a
from reviewlens.plans import fixtures, review
from reviewlens.plans.catalog import QUERIES, _project, marked, query
from reviewlens.sources import readers
from reviewlens.sources.shared import folder, written
from reviewlens.streaming import tasks

__all__ = ["QUERIES"]


def _cases(spark, d, cases, *columns):
    """Every event with one of the literal cases, by its number; ``case`` is that number."""
    literal = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, x, strict=True)]) for x in cases])
    k = (F.col("event_id") % len(cases)).cast("int")
    return a.table(spark, d, "events").select("event_id", k.alias("case"), F.get(literal, k).alias("x")).select("event_id", "case", "x.*")


# --- every rule, every pattern -------------------------------------------------


@query
def rule_hits(spark, d):
    """A line that hits, and ones that nearly do, for each rule and kind of file."""
    lines = _cases(spark, d, fixtures.RULE_LINES, "path", "text").select(F.lit("r").alias("review_id"), F.col("path").alias("file_path"), F.col("event_id").alias("pos"), F.col("text").alias("line"))
    return rules.scan(lines).select((F.col("line") - 1).cast("long").alias("event_id"), "rule", "type", "severity")


@query
def fp_patterns(spark, d):
    """F9-F12, AGG8: a message for each of the patterns, in Java, C++ and TypeScript files."""
    i = _cases(spark, d, [(m,) for m, _ in fixtures.EXCLUDED], "message")
    ext = F.element_at(F.array(F.lit(".java"), F.lit(".cpp"), F.lit(".ts")), (F.floor(F.col("event_id") / len(fixtures.EXCLUDED)) % 3 + 1).cast("int"))
    i = i.select(F.col("event_id").alias("ord"), F.concat(F.lit("src/a"), ext).alias("file"), F.lit("finding").alias("type"), "message", F.lit("").alias("suggestion"))
    return filters.mark(i).select("ord", "file", F.col("filter_metadata.reason").alias("reason"))


@query
def fp_test_files(spark, d):
    """documents and test files by each ending."""
    i = _cases(spark, d, [(p,) for p, _ in fixtures.PATHS], "file")
    i = i.select(F.col("event_id").alias("ord"), "file", F.lit("finding").alias("type"), F.lit("a plain message").alias("message"), F.lit("").alias("suggestion"))
    return filters.mark(i).select("ord", F.col("filter_metadata.reason").alias("reason"))


@query
def loaded_rules(spark, d):
    """SRC10, F9-F12: rules of a text go before the defaults."""
    own = filters.Exclusions().with_rules(readers.rules_of(fixtures.RULES_TEXT))
    return filters.mark(a.issues(spark, d), own).select("ord", F.col("filter_metadata.reason").alias("reason"))


@query
def staged_report(spark, d):
    """§2.12: stages listed in a text, one of them switched off."""
    return review.compose(review.stages_of(fixtures.STAGES_TEXT))(diff.to_lines(a.files(spark, d))).select("severity", "n", "files")


@query
def settings_overlay(spark, d):
    """SRC11."""
    defaults = {"max_files": 20, "llm": {"model": "base", "retries": 3}}
    cases = {"none": (None, None), "home": (None, {"max_files": 9, "llm": {"model": "h"}}), "project": ({"language": "fr", "llm": {"retries": 1}}, {"max_files": 9}), "empty": ({}, {"max_files": 9})}
    found = {k: readers.load_settings(p, h, defaults) for k, (p, h) in cases.items()}
    return spark.createDataFrame([(k, s.max_files, s.language, s.extra["llm"]["model"], s.extra["llm"]["retries"]) for k, s in found.items()], "given string, max_files int, language string, model string, retries int")


# --- sources and sinks ---------------------------------------------------------


@query
def pull_specs(spark, d):
    """SRC3, SRC4."""
    f = a.files(spark, d)
    text = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" "), "review_id", F.lit("/repo.x#"), "ord", F.lit(" "))).when(F.col("ord") % 3 == 1, F.concat("review_id", F.lit("#"), "ord")).otherwise(F.concat("review_id", F.lit("/repo#x"), "ord"))
    spec = diff.pull_request(text)
    return f.select("ord", spec["owner"].alias("owner"), spec["repo"].alias("repo"), spec["number"].alias("number"), F.md5(diff.unified(F.col("file_path"), F.col("content"))).alias("patch"))


@query
def pull_files(spark, d):
    """SRC2, SRC5: pages of a listing, the sixth of them short, written to the shared folder and read page by page."""
    key = F.col("p_partkey")
    parts = a.table(spark, d, "part").select((F.floor(key / readers.PAGE) + 1).cast("int").alias("page"), (key % readers.PAGE).alias("k"), "p_name", "p_brand", "p_type").where("page != 6 or k < 40")
    files = F.struct("k", F.struct(F.col("p_name").alias("filename"), F.col("p_brand").alias("status"), F.col("p_type").alias("patch")).alias("f"))
    pages = parts.groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(files)), lambda x: x["f"])).alias("body"))
    return readers.pull_request_files(written(pages, "pages"), 1150).select("page", "ord", "file_path", "status", "patch")


@query
def project_scan(spark, d):
    """SRC8, SRC9: a project's sources, and of all files those that a guard lets through."""
    f = a.files(spark, d)
    k = F.col("ord") % 6
    path = F.when(k == 0, F.concat(F.lit("target/"), "file_path")).when(k == 1, F.concat(F.lit("app/build/"), "file_path")).when(k == 2, F.concat(F.lit("app/../"), "file_path")).when(k == 3, F.concat(F.lit("/"), "file_path")).otherwise(F.concat(F.lit("app/"), "file_path"))
    f = f.select("ord", path.alias("file_path"), F.when(k == 4, F.concat(F.lit("@Generated\n"), "content")).otherwise(F.col("content")).alias("content"))
    sources = readers.project_sources(f.select("file_path", "content"))
    listed = f.where("ord % 2 = 1").select("file_path")
    seen = readers.guarded(f.select("file_path", "content"), listed, 2000)
    return sources.select(F.lit("source").alias("what"), "file_path").unionByName(seen.select(F.lit("guarded").alias("what"), "file_path"))


@query
def vector_store(spark, d):
    """SRC14: vectors added, some replaced, some deleted; then a search."""
    store = readers.VectorTable(spark, folder(spark, "store"))
    v = a.table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "vec_id", "embedding")
    store.add(v)
    store.add(v.where("vec_id % 3 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    store.delete(v.where("vec_id % 7 = 2"))
    first = v.orderBy("vec_id").first()["embedding"]
    return store.search(first, 10).select("chunk_id", F.round("score", 4).alias("score"), F.lit(store.count()).cast("long").alias("left"))


@query
def embedded(spark, d):
    """RET3: an injected function; where it fails, the row says so."""

    def embed(texts):
        if any(len(t) % 5 == 0 for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    docs = a.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = retrieval.embed(docs, embed, batch=1)
    return out.select("chunk_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), "error")


@query
def agent_replies(spark, d):
    """SRC17, ST11, §2.12: a call for each chunk and reviewer; failures are classified, not raised."""

    def reviewer(name, text):
        if name == "logic" and len(text) % 2:
            raise RuntimeError("HTTP 503")
        return f"{name}:{len(text)}"

    chunks = a.files(spark, d).select("review_id", F.col("ord").cast("int").alias("chunk"), F.col("content").alias("text"))
    return readers.review(chunks, reviewer).select("review_id", "chunk", "reviewer", "reply", "kind")


@query
def posted_comments(spark, d):
    """SNK3: batches that hold a comment on a seventh line fail, and those comments are skipped."""

    def one(comment):
        if comment["line"] % 7 == 0:
            raise ValueError("refused")

    def batch(comments):
        raise ValueError("down")

    m = marked(spark, d)
    shown = issues.comments(m, m.select(F.col("file").alias("path")).distinct())
    return report.post(shown, batch, one).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def metered_issues(spark, d):
    """SNK8: counters filled by the action that they ride on."""
    seen, counters = report.metered(a.issues(spark, d), "metered")
    _, seconds = report.timed(lambda: seen.write.format("noop").mode("overwrite").save(), time.perf_counter)
    c = counters.get
    return spark.createDataFrame([(c["total"], c["critical"], c["warning"], c["info"], seconds > 0)], "total long, critical long, warning long, info long, timed boolean")


@query
def queue_round_trip(spark, d):
    """SRC16: messages published as JSON lines and read back by a stream."""
    e = a.table(spark, d, "events")
    mode = F.when(F.col("event_type") == "error", "MULTI_AGENT").when(F.col("event_type") == "view", "PIPELINE").otherwise("simple")
    t = e.select(F.concat(F.lit("t"), "event_id").alias("task_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), "event_id")).otherwise("").alias("request_id"), mode.alias("mode"), (F.col("value") > 100).alias("hotfix"))
    path = folder(spark, "queue")
    tasks.publish(t, path)
    return tasks.run_to_table(tasks.read_queue(spark, path), "queue").select("task_id", "request_id", "queue", "priority")


@query
def stream_breaker(spark, d):
    """ST9: the breaker as a stateful stream gives what the window gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = tasks.stream_table(spark, d, "events.parquet", spark.read.parquet(f"{d}/events.parquet").schema)
    calls = e.select(F.concat(F.lit("u"), "user_id").alias("caller"), F.col("event_id").alias("call_id"), F.unix_micros("ts").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return tasks.run_to_table(tasks.breaker_states(calls), "breaker").select("caller", "call_id", "calls", F.round("failure_rate", 6).alias("failure_rate"), "open")


@query
def live_resources(spark, d):
    """ST7, U5: what belongs to sessions that still live."""
    s = a.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("created_at")).withColumn("session_id", F.col("user_id"))
    now = F.lit("2024-01-01 06:00:00").cast("timestamp")
    live = tasks.live_sessions(s.where(F.col("created_at") <= now), now, 120)
    return tasks.in_active_sessions(a.table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id"), live)


# --- diffs, texts, merging -----------------------------------------------------


@query
def diff_without_excluded(spark, d):
    """whole diffs without the sections of two folders."""
    whole = a.diffs(spark, d).groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "diff_text"))), lambda x: x["diff_text"]), "\n").alias("diff_text"))
    by_tens = whole.withColumn("diff_text", F.regexp_replace("diff_text", r"(diff --git a/|b/|--- a/|\+\+\+ b/)src(\d*)/(\d*)([05])\.", "$1gen/src$2/$3$4."))
    kept = diff.without_excluded(by_tens.withColumnRenamed("review_id", "diff_id"), ["gen"])
    return diff.sections(kept).select("diff_id", "file_path", F.md5(F.rtrim(F.col("content"), F.lit("\n"))).alias("content"))


@query
def overlapping_ranges(spark, d):
    """F16: ranges of lines that hold a changed line of their review's diffs."""
    changed = diff.changed_lines(a.diff_lines(spark, d), "diff_id", every=True)
    f = a.files(spark, d)
    ranges = f.select(F.col("file_path").alias("diff_id"), (F.col("ord") % 9 + 1).cast("int").alias("start_line"), (F.col("ord") % 9 + 1 + F.col("ord") % 2).cast("int").alias("end_line"))
    return diff.overlapping(ranges, changed, "diff_id").select("diff_id", "start_line", "end_line")


@query
def allowed_files(spark, d):
    """F18."""
    f = a.files(spark, d)
    given = F.when(F.col("ord") % 3 == 0, F.array(F.concat(F.lit(" "), "file_path"), F.lit(""), F.col("file_path"))).when(F.col("ord") % 3 == 1, F.array(F.lit(" "), F.lit("")))
    return f.select("ord", F.array_join(diff.allowed(given, F.array(F.lit("all"), F.lit("of them"))), "|").alias("paths"))


@query
def batch_merge(spark, d):
    """AGG15."""
    i = a.issues(spark, d)
    part = i.groupBy("review_id", (F.col("ord") % 4).alias("ord")).agg(F.count_distinct("file").alias("files"), F.bool_or(F.col("severity") == "CRITICAL").alias("has_critical"), F.array_sort(F.collect_list(F.col("ord"))).alias("issues"))
    part = part.withColumn("raw", F.when(F.col("ord") != 2, F.concat(F.lit("batch "), "ord")))
    out = issues.merge_batches(part)
    return out.select("review_id", "files", "has_critical", "raw", F.md5(F.array_join(F.col("issues").cast("array<string>"), ",")).alias("issues"))


@query
def parse_errors(spark, d):
    """AGG21."""
    i = a.issues(spark, d)
    return issues.parse_error_text(i.where("ord % 2 = 0").select(F.col("file").alias("file_path"), "ord", F.concat(F.lit("e"), "ord").alias("error")))


@query
def preview_text(spark, d):
    """T7."""
    f = a.files(spark, d)
    return f.select("ord", F.md5(retrieval.preview(F.regexp_replace("content", r"\. ", ".\n"))).alias("preview"))


@query
def merged_issues(spark, d):
    """Static and reviewed issues in one frame, deduplicated together."""
    i = a.issues(spark, d).select("review_id", "ord", "severity", "file", "line", "type", "message", "suggestion")
    static = i.where("ord % 2 = 0").withColumn("rule", F.lit("R"))
    both = review.merged(static, i.where("ord % 2 = 1"))
    return issues.deduplicate(both, keys=("review_id",)).groupBy("review_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count("rule").alias("static"))


@query
def safe_prompt(spark, d):
    """§2.9: templates, and closing tags that can't end the prompt's own sections."""
    f = a.files(spark, d)
    tag = F.element_at(F.array(*[F.lit(t) for t in ("</diff_input>", "</diff>", "</user_input>", "</other>", "<diff>")]), (F.col("ord") % 5 + 1).cast("int"))
    return f.select("ord", F.md5(fill("<diff_input>{{diff}}</diff_input> by {{who}}, {{who}}", {"diff": neutral(F.concat("content", tag, F.lit(" end"))), "who": F.col("review_id")})).alias("prompt"))


@query
def durations(spark, d):
    """§2.9 date and time, and the token counts of providers."""
    e = a.table(spark, d, "events")
    ms = F.col("event_id") * 37 % 250 * 20
    return e.select("event_id", duration(ms).alias("took"), provider_tokens(F.col("event_id").cast("int"), "Claude").cast("long").alias("claude"), provider_tokens(F.col("event_id").cast("int"), "other").cast("long").alias("other"))


@query
def severity_maps(spark, d):
    """§2.9 maps: counts by severity as maps, added up over two halves."""
    i = a.issues(spark, d)
    one, two = (issues.severity_maps(i.where(F.col("ord") % 3 == 0)), issues.severity_maps(i.where((F.col("ord") % 3 != 0) & (F.col("severity") != "INFO"))).withColumnRenamed("counts", "more"))
    both = one.join(two, "review_id", "full").select("review_id", issues.merged_maps(F.col("counts"), F.col("more")).alias("m"))
    entry = F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return both.select("review_id", F.array_join(entry, ",").alias("counts"), F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda k, v: v % 2 == 0))), ",").alias("even"))


# --- packing on literal entries --------------------------------------------------


@query
def chunk_cases(spark, d):
    """PK1, PK2, T8: reviews that fit, that are cut by files, characters or tokens, and one without entries."""
    rows = [(r, k, f"f{k}", "x" * chars, tokens) for r, items in fixtures.CHUNK_CASES.items() for k, (chars, tokens) in enumerate(items)]
    entries = spark.createDataFrame(rows, "review_id string, ord long, file_path string, content string, token_count int")
    reviews = spark.createDataFrame([(r,) for r in fixtures.CHUNK_CASES] + [("nothing",)], "review_id string")
    out = packing.chunks(entries, 3, 100, 50, 30, reviews)
    return out.groupBy("review_id", "chunk").agg(F.array_join(F.array_sort(F.collect_list("ord")).cast("array<string>"), ",").alias("entries"))


@query
def hunk_cases(spark, d):
    """PK3, PK4, W4: oversized entries, cut between hunks and within one."""
    entries = spark.createDataFrame([("r", k, name, text, 0) for k, (name, text) in enumerate(fixtures.HUNK_CASES)], "review_id string, ord long, file_path string, content string, token_count int")
    return packing.split_oversized(entries, 60, 1000).select("file_path", "part", "content")


@query
def compact_cases(spark, d):
    """PK5."""
    e = a.files(spark, d).select("review_id", (F.col("ord") % 3).cast("int").alias("chunk"), "ord", "file_path")
    return packing.compact(e).select("review_id", "chunk", F.md5("text").alias("text"))


# --- the literal project -----------------------------------------------------------


@query
def class_index(spark, d):
    """AGG13: the four indexes, as rows."""
    f = _project(spark)[1]
    where, faces, parent = facts.indexes(f)
    out = where.select(F.lit("path").alias("kind"), F.col("class_name").alias("name"), F.col("path").alias("value"))
    out = out.unionByName(faces.select(F.lit("implementations").alias("kind"), F.col("interface").alias("name"), F.array_join("implementations", ",").alias("value")))
    out = out.unionByName(parent.select(F.lit("parent").alias("kind"), F.col("class_name").alias("name"), F.col("parent").alias("value")))
    return out.unionByName(facts.methods_of(f).select(F.lit("methods").alias("kind"), F.col("class_name").alias("name"), F.array_join("methods", ",").alias("value")))


@query
def callee_lists(spark, d):
    """AGG14."""
    return facts.callees_text(_project(spark)[1]).select("owner", "caller", "callees")


@query
def graph_relations(spark, d):
    """GR2: each relation of a node."""
    nodes, edges = graph.build(_project(spark)[1])
    asked = [("implementations", "class:src/shop/dao/OrderDao.java:OrderDao"), ("parent", "class:src/shop/service/OrderService.java:OrderService"), ("subclasses", "class:src/shop/service/BaseService.java:BaseService"),
             ("members", "class:src/shop/dao/SqlOrderDao.java:SqlOrderDao"), ("members", "file:src/shop/service/BaseService.java"), ("callers", "method:src/shop/dao/OrderDao.java:OrderDao.save(String)"),
             ("callees", "method:src/shop/OrderController.java:OrderController.handle(String)")]
    out = None
    for relation, ident in asked:
        part = graph.neighbours(edges, nodes, ident, relation).select(F.lit(relation).alias("relation"), F.lit(basename(F.lit(ident))).alias("node"), "name")
        out = part if out is None else out.unionByName(part)
    return out


@query
def graph_hierarchy(spark, d):
    """AGG13, JN10, JN11."""
    return graph.class_hierarchy(_project(spark)[1])


@query
def graph_query_verbs(spark, d):
    """GR6: callers and callees."""
    nodes, edges = graph.build(_project(spark)[1])
    return graph.query("callers OrderDao.save", nodes, edges).select(F.lit("callers").alias("verb"), "name").unionByName(graph.query("callees OrderService.process", nodes, edges).select(F.lit("callees").alias("verb"), "name"))


@query
def other_language(spark, d):
    """CH3, §2.12: a provider for another extension beside Java's."""

    def python_facts(text):
        lines = [x for x in text.split("\n") if x.startswith("def ")]
        return [{"kind": "method", "ord": k, "name": x[4 : x.index("(")], "owner": "", "type": "", "detail": "", "names": [], "start_line": 0, "end_line": 0} for k, x in enumerate(lines)]

    e = a.table(spark, d, "events").select(F.concat(F.lit("f"), "event_id", F.when(F.col("event_id") % 2 == 0, ".py").otherwise(".java")).alias("file_path"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("def a"), "user_id", F.lit("(x):\n pass\ndef b():\n"))).otherwise(F.concat(F.lit("class C"), "user_id", F.lit(" { void m() { } }"))).alias("content"))
    return facts.analyze(e, {**facts.PROVIDERS, ".py": python_facts}).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query
def index_project(spark, d):
    """RET5: every document as a file of its own, from text to weights: the postings of each chunk."""
    f = a.files(spark, d).select(F.concat("file_path", F.lit(".java")).alias("file_path"), "content")
    chunks, vocab, weights = retrieval.index_project(f)
    per = weights.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))
    return chunks.where("granularity = 'FILE'").join(per, "chunk_id").select("file_path", "terms", "norm")


@query
def tool_calls(spark, d):
    """§2.12: each of the six tools, an unknown one, and one that complains."""
    files, _ = _project(spark)
    entries = files.select(F.lit("r").alias("review_id"), F.monotonically_increasing_id().alias("ord"), "file_path", "content", F.lit(10).alias("token_count"))
    registry = tools.default_tools(tools.project_of(files, entries, files.where("file_path not like '%Broken%'").select("file_path")))
    asked = [("get_file_content", "src/shop/dao/OrderDao.java"), ("get_file_content", "src/shop/Broken.java"), ("get_diff_context", "src/shop/Broken.java"), ("get_method_definition", "SqlOrderDao.save"), ("get_method_definition", "save"),
             ("get_call_graph", "impact OrderDao.save"), ("get_call_graph", "who knows"), ("get_related_files", "OrderService"), ("semantic_search", "order dao save"), ("nothing", "x")]
    out = None
    for name, argument in asked:
        got = registry.call(name, argument)
        ok = F.lit("error" not in got.columns)
        part = got.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tool"), F.lit(argument).alias("argument"), "n", ok.alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def polled(spark, d):
    """ST10: a result that comes on the third look, and one that never comes."""
    rows = []
    for need, timeout in ((3, 60), (99, 7)):
        looks: list[int] = []

        def fetch(looks=looks):
            looks.append(1)
            return {"looks": len(looks)}

        try:
            state = readers.poll(fetch, lambda s, need=need: s["looks"] >= need, lambda looks=looks: 2.0 * len(looks), lambda _: None, timeout, 2.0)
            rows.append((need, state["looks"], "done"))
        except TimeoutError:
            rows.append((need, len(looks), "timeout"))
    return spark.createDataFrame(rows, "need int, looks int, outcome string")
