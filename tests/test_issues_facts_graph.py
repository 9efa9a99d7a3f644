import random

from pyspark.sql import functions as F

from reviewlens.operators import cache, facts, graph, issues, resilience, retrieval
from reviewlens.plans import fixtures, review
from reviewlens.sources import readers, replies

ISSUES = "ord long, severity string, file string, line int, type string, message string, suggestion string"


def model_dedup(rows):
    rank = {"CRITICAL": 3, "WARNING": 2, "INFO": 1}
    seen = {}
    for r in rows:
        o, s, f, n, t, m, g = r
        norm = lambda x: " ".join((x or "").split()).lower()[:240]
        key = (f, t.lower(), n, norm(m)) if n is not None and n >= 0 else (f, t.lower(), norm(m), norm(g), None)
        if key not in seen or rank.get(s, 0) > rank.get(seen[key][1][1], 0):
            seen[key] = (seen[key][0] if key in seen else o, r)
    return sorted((first, r[1], r[5]) for first, r in seen.values())


def test_dedup_equals_the_model(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["CRITICAL", "WARNING", "INFO", "odd"]), rng.choice("ab"), rng.choice([None, 0, 3]), rng.choice(["T", "t"]), rng.choice(["m  x", "M x", "n"]), rng.choice(["", "s"])) for k in range(200)]
    got = sorted((r["ord"], r["severity"], r["message"]) for r in issues.deduplicate(spark.createDataFrame(rows, ISSUES)).collect())
    assert got == model_dedup(rows)
    assert issues.deduplicate(spark.createDataFrame([], ISSUES)).count() == 0


def test_routing(spark):
    focus = spark.createDataFrame([("r", 1, "Security", ["a", "zz"]), ("r", 2, "sec2", ["b"]), ("r", 3, "Qual", [])], "review_id string, ord int, key string, paths array<string>")
    files = spark.createDataFrame([("r", p) for p in "abc"], "review_id string, path string")
    got = sorted((r["reviewer"], r["path"]) for r in issues.route_files(focus, files).collect())
    assert got == [("logic", "c"), ("quality", "c"), ("security", "b"), ("security", "c")]


def test_chunk_outcomes(spark):
    rows = [("a", 0, "x", True, False, None), ("a", 1, "y", False, True, None), ("b", 0, None, None, False, "e"), ("c", 0, "p", False, False, None), ("c", 1, None, None, False, "e")]
    got = {r["review_id"]: (r["status"], r["summary"], r["has_critical"]) for r in issues.merge_chunks(spark.createDataFrame(rows, "review_id string, ord int, summary string, has_critical boolean, used_fallback boolean, error string")).collect()}
    assert got == {"a": ("COMPLETED", "[fallback] [2-batch review] x | y", True), "b": ("FAILED", "[partial 0/1] Reviewed changes across 1 batches.", False), "c": ("PARTIAL", "[partial 1/2] p", False)}


def test_usage_names(spark):
    rows = [("r", '{"token_usage":{"prompt_tokens":3,"completion_tokens":4}}', None, '{"input_tokens":99}'), ("r", None, None, '{"input_tokens":1,"output_tokens":2,"total_tokens":9}'), ("r", "{}", '{"usage":{"prompt_token_count":5}}', None), ("r", "bad", None, None)]
    got = issues.token_usage(spark.createDataFrame(rows, "run_id string, llm_output string, generation_info string, usage_metadata string")).first()
    assert tuple(got) == ("r", 9, 6, 21, 4)


def _project(spark):
    files = spark.createDataFrame(fixtures.PROJECT, "file_path string, content string")
    return files, facts.analyze(files)


def test_facts(spark):
    _, f = _project(spark)
    rows = f.collect()
    kinds = lambda k: {(r["owner"], r["name"]) for r in rows if r["kind"] == k}
    assert ("OrderService", "process") in kinds("method") and ("", "OrderDao") in kinds("type") and ("BaseService", "Helper") in kinds("type")
    assert [r["file_path"] for r in rows if r["kind"] == "parse_error"] == ["src/shop/Broken.java"]
    assert {r["name"] for r in rows if r["kind"] == "flow"} == {"IF", "FOR_EACH", "WHILE", "TRY_CATCH"}
    assert {(r["name"], r["detail"]) for r in rows if r["kind"] == "data"} >= {("total", "declaration"), ("total", "assignment")}
    assert {(r["name"], r["detail"]) for r in rows if r["kind"] == "access"} == {("count", "write")}


def test_graph_of_a_project(spark):
    nodes, edges = graph.build(_project(spark)[1])
    has = {(r["type"], r["src"].rsplit(":", 1)[-1], r["dst"].rsplit(":", 1)[-1]) for r in edges.collect()}
    assert ("CALLS", "OrderController.handle(String)", "OrderService.process(String)") in has
    assert ("CALLS", "OrderService.process(String)", "OrderDao.save(String)") in has
    assert ("EXTENDS", "OrderService", "BaseService") in has and ("IMPLEMENTS", "SqlOrderDao", "OrderDao") in has
    assert ("IMPORTS", "src/shop/OrderController.java", "src/shop/service/OrderService.java") in has
    assert graph.build(_project(spark)[1], exact_imports=True)[1].where("type = 'IMPORTS'").count() == 0
    got = [r["name"] for r in graph.query("callers OrderService.process", nodes, edges).collect()]
    assert got == ["handle"]
    assert {r["name"] for r in graph.query("impact save", nodes, edges).collect()} == {"handle", "process"}


def test_impact_with_cycles_and_paths(spark):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)]
    edges = spark.createDataFrame([(a, b, "CALLS", -1) for a, b in pairs], "src string, dst string, type string, line int")
    want, frontier, seen = {}, {"n0"}, {"n0"}
    for depth in (1, 2, 3):
        frontier = {a for a, b in pairs if b in frontier} - seen
        seen |= frontier
        want |= dict.fromkeys(frontier, depth)
    got = {r["id"]: r["depth"] for r in graph.impact(edges, spark.createDataFrame([("n0",)], "id string"), 3).collect()}
    assert got == want
    dist, level, reach = 0, {"n1"}, {"n1"}
    while "n0" not in level and level:
        level = {b for a, b in pairs if a in level} - reach
        reach |= level
        dist += 1
    path = graph.shortest_path(edges, "n1", "n0").orderBy("step").collect()
    assert len(path) == (dist if level else 0)
    assert all(x["dst"] == y["src"] for x, y in zip(path, path[1:], strict=False))


def test_a_path_of_more_than_twenty_edges(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "CALLS", k) for k in range(22)] + [("n3", "n1", "CALLS", -1)], "src string, dst string, type string, line int")
    path = graph.shortest_path(edges, "n0", "n22").orderBy("step").collect()
    assert [(r["src"], r["dst"], r["line"]) for r in path] == [(f"n{k}", f"n{k + 1}", k) for k in range(22)]
    assert graph.shortest_path(edges, "n20", "n0").count() == 0


def test_tfidf_unit_norm_and_small_corpora(spark):
    docs = spark.createDataFrame([(1, "class OrderService { processOrder(); }"), (2, "HTTPServer parseXML user_id 42"), (3, ""), (4, "order order process")], "doc_id long, text string")
    tf = retrieval.terms(docs)
    assert {r["term"] for r in tf.where("doc_id = 2").collect()} == {"http", "server", "parse", "xml", "user", "id", "42"}
    vocab = retrieval.vocabulary(tf, 4)
    w = retrieval.weights(docs, vocab, 4)
    norms = {r["doc_id"]: r["n"] for r in w.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()}
    assert all(abs(n - 1) < 1e-9 for n in norms.values()) and set(norms) == {1, 2, 4}
    q = w.where("doc_id = 1").select("term", "weight")
    assert [r["doc_id"] for r in retrieval.search_terms(w, q, 2).collect()] == [1, 4]
    assert retrieval.search_terms(w.limit(0), q, 2).count() == 0


def test_embedding_boundary(spark):
    def embed(texts):
        if any("boom" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    docs = spark.createDataFrame([("a", "xx"), ("b", "boom")], "chunk_id string, text string").coalesce(1)
    got = {r["chunk_id"]: (r["embedding"], r["error"]) for r in retrieval.embed(docs, embed, batch=1).collect()}
    assert got == {"a": ([2.0], None), "b": (None, "no")}


def test_replies(spark):
    df = spark.createDataFrame(fixtures.REPLIES, "reply_id string, text string")
    got = {r["reply_id"]: r for r in replies.parse(df).collect()}
    assert got["object"]["issues"][0]["severity"] == "CRITICAL" and got["object"]["has_critical"]
    assert got["array"]["has_critical"] is None and got["plain"]["is_raw"] and got["plain"]["raw"] == "Looks good to me."
    assert got["braces"]["issues"][0]["message"] == "a } in a string"
    assert not got["blank"]["is_raw"] and got["broken"]["is_raw"]
    loose = {r["reply_id"]: r for r in replies.parse(df, "loose").collect()}
    assert loose["prose"]["issues"][0]["message"] == "m"


def test_cache_round(spark):
    entries = cache.keyed(spark.createDataFrame([("r", 0, "a", "x"), ("r", 1, "b", "y")], "review_id string, ord int, file_path string, content string"), "m", ["q", " p"], "en", True)
    same = cache.keyed(entries.drop("key"), "m", ["p", "q "], "en", True)
    assert [r["key"] for r in entries.collect()] == [r["key"] for r in same.collect()]
    found = spark.createDataFrame([("r", 0, "b", "CRITICAL", "t", 3, "m"), ("r", 1, None, "INFO", "t", None, "n")], "review_id string, ord int, file string, severity string, type string, line int, message string")
    written = {r["key"]: [i["severity"] for i in r["issues"]] for r in cache.to_write(entries, found).collect()}
    keys = {r["file_path"]: r["key"] for r in entries.collect()}
    assert written == {keys["a"]: ["INFO"], keys["b"]: ["CRITICAL"]}


def test_breaker_opens(spark):
    calls = spark.createDataFrame([("c", k, k, k % 2 == 0) for k in range(12)], "caller string, ts int, call_id int, failed boolean")
    got = [(r["calls"], r["open"]) for r in resilience.breaker(calls).orderBy("call_id").collect()]
    assert got[3] == (4, False) and got[4] == (5, True) and got[11] == (10, True)


def test_settings_and_stages(spark):
    assert readers.load_settings({"max_files": 3}, {"max_files": 9, "language": "fr"}).language == "en"
    assert readers.load_settings(None, {"max_files": 9}).max_files == 9
    assert readers.load_rules("/nowhere.yaml", [{"id": 1}]) == [{"id": 1}]
    run = review.compose(["unknown", "visible"], {"visible": lambda df: df.where("x > 1")})
    assert run(spark.range(4).toDF("x")).count() == 2


def test_review_boundary_and_retry(spark):
    def reviewer(name, text):
        if name == "logic":
            raise RuntimeError("down")
        return f"{name}:{text}"

    got = readers.review(spark.createDataFrame([("r", 0, "t")], "review_id string, chunk int, text string"), reviewer).orderBy("ord").collect()
    assert [(r["reviewer"], r["reply"], r["error"]) for r in got] == [("logic", None, "RuntimeError: down"), ("quality", "quality:t", None), ("security", "security:t", None)]
    slept, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError("429")
        return "ok"

    assert readers.with_retry(call, lambda e: "rate_limit", slept.append)() == "ok" and slept == [2.0, 4.0]


def test_reviews_run_where_their_chunks_lie(spark):
    """No text is shuffled, so a task reads no more of more chunks; a bound on the tasks is kept."""
    chunks = spark.range(0, 400, 1, 20).select(F.lit("r").alias("review_id"), F.col("id").cast("int").alias("chunk"), F.lit("t").alias("text"))
    out = readers.review(chunks, lambda name, text: name)
    assert out.rdd.getNumPartitions() == 20 and "Exchange" not in out._jdf.queryExecution().toString()
    assert out.count() == 1200 and out.select("ord").distinct().count() == 1200
    two = readers.review(chunks, lambda name, text: name, ("logic",), 2)
    assert two.rdd.getNumPartitions() == 2 and two.count() == 400


def test_files_without_facts_are_not_tokenized(monkeypatch):
    from reviewlens.operators import facts

    read = []
    run = facts.JavaFacts.run
    monkeypatch.setattr(facts.JavaFacts, "run", lambda self: read.append(1) or run(self))
    for text in ("", "an important classic, 3 records", "classes {", "import$ed class_ records"):
        assert facts.java_facts(text) == [] and not read
    for text, kinds in (("éclass A { }", ["type"]), ("import a.b;", ["import"]), ("x.class y", []), ("1class B { }", []), ("// class C { }", [])):
        read.clear()
        assert [r["kind"] for r in facts.java_facts(text)] == kinds and read
