import json

from pyspark.sql import functions as F

from reviewlens.sources import readers
from reviewlens.streaming import tasks


def test_pages_stop_after_a_short_one(spark, tmp_path):
    for page, n in ((1, 100), (2, 30), (3, 100)):
        (tmp_path / f"{page}.json").write_text(json.dumps([{"filename": f"f{page}-{k}", "status": "modified", "patch": "@@"} for k in range(n)]))
    pages = readers.listing_pages(spark, str(tmp_path))
    assert readers.pull_request_files(pages, 1000).count() == 130
    assert [r["ord"] for r in readers.pull_request_files(pages, 110).orderBy("ord").collect()] == list(range(110))
    (tmp_path / "2.json").unlink()
    assert readers.pull_request_files(readers.listing_pages(spark, str(tmp_path)), 1000).count() == 100
    (tmp_path / "1.json").write_text("broken")
    assert readers.pull_request_files(readers.listing_pages(spark, str(tmp_path)), 1000).count() == 0


def test_exported_diffs(spark, tmp_path):
    (tmp_path / "a.diff").write_text("diff --git a/x b/x\n+1\n")
    assert [tuple(r) for r in readers.exported_diffs(spark, str(tmp_path)).collect()] == [("a.diff", "diff --git a/x b/x\n+1\n")]


def test_texts_of_rules_settings_and_stages(tmp_path):
    from reviewlens.plans import review

    (tmp_path / "r.json").write_text('{"exclusion_rules": [{"description": "d"}]}')
    assert readers.load_rules(str(tmp_path / "r.json")) == [{"description": "d"}]
    assert readers.load_rules(str(tmp_path / "none.json"), [{"description": "f"}]) == [{"description": "f"}]
    assert readers.rules_of("{", [{"description": "f"}]) == [{"description": "f"}]
    s = readers.load_settings({"llm": {"model": "m"}, "max_files": 3}, {"max_files": 9}, {"llm": {"model": "x", "url": "u"}, "language": "de"})
    assert (s.max_files, s.language, s.extra) == (3, "de", {"llm": {"model": "m", "url": "u"}})
    assert review.stages_of('{"pipeline": {"stages": ["a", {"name": "b", "enabled": false}, {"name": "c"}, 3]}}') == ["a", "c"]
    assert review.stages_of("{") == []


def test_poll():
    states, slept = iter([{"s": 0}, {"s": 0}, {"s": 1}]), []
    assert readers.poll(lambda: next(states), lambda x: x["s"], lambda: len(slept), slept.append, 10, 2) == {"s": 1} and slept == [2, 2]
    import pytest

    with pytest.raises(TimeoutError):
        readers.poll(dict, bool, lambda: len(slept), slept.append, 3, 1)


def test_project_scan_and_guard(spark, tmp_path):
    for path, text in (("src/A.java", "class A {}"), ("target/B.java", "x"), ("src/build/C.java", "x"), ("src/G.java", "@Generated class G {}"), ("x.py", "")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = readers.project_files(spark, str(tmp_path))
    assert [r["file_path"] for r in files.collect()] == ["src/A.java"]
    rows = spark.createDataFrame([("a/../b", "x"), ("/etc/p", "x"), ("ok", "x"), ("big", "x" * 100_001), ("other", "x")], "file_path string, content string")
    allowed = spark.createDataFrame([("a/../b",), ("/etc/p",), ("ok",), ("big",)], "file_path string")
    assert [r["file_path"] for r in readers.guarded(rows, allowed).collect()] == ["ok"]


def test_vector_table(spark, tmp_path):
    t = readers.VectorTable(spark, str(tmp_path / "v"))
    assert t.count() == 0 and t.search([1.0], 3).count() == 0
    t.add(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [1.0])], "chunk_id string, embedding array<float>"))
    assert [r["chunk_id"] for r in t.search([0.6, 0.8], 2).collect()] == ["b", "a"]
    t.add(spark.createDataFrame([("a", [0.0, 1.0])], "chunk_id string, embedding array<float>"))
    t.delete(spark.createDataFrame([("c",), ("none",)], "chunk_id string"))
    assert t.count() == 2 and [r["chunk_id"] for r in t.search([0.6, 0.8], 1).collect()] == ["b"]
    assert {r["chunk_id"]: list(r["embedding"]) for r in t.read().collect()}["a"] == [0.0, 1.0]
    t.compact()
    assert t.count() == 2
    t.clear()
    assert t.count() == 0


def test_queue_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "", "PIPELINE", True), ("t2", "r2", "simple", False)], "task_id string, request_id string, mode string, hotfix boolean")
    tasks.publish(rows, str(tmp_path / "q"))
    got = {r["task_id"]: r for r in tasks.run_to_table(tasks.read_queue(spark, str(tmp_path / "q")), "queue_round").collect()}
    assert got["t1"]["request_id"] == "t1" and got["t1"]["priority"] == 9 and got["t1"]["queue"] == "pipeline"
    assert got["t2"]["request_id"] == "r2" and got["t2"]["priority"] == 5 and got["t2"]["queue"] == "simple"


def test_task_states_and_breaker_stream(spark, tmp_path):
    e = [("t", 1, 1, "PENDING"), ("t", 2, 2, "COMPLETED"), ("t", 3, 3, "RUNNING"), ("t", 4, 4, "FAILED"), ("t", 5, 5, "RUNNING")]
    spark.createDataFrame(e, "task_id string, event_id long, ts long, status string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("task_id string, event_id long, ts long, status string").parquet(str(tmp_path / "e"))
    got = tasks.run_to_table(tasks.task_states(stream), "states").orderBy("event_id").collect()
    assert [(r["before"], r["status"], r["applied"]) for r in got] == [(None, "PENDING", True), ("PENDING", "COMPLETED", False), ("PENDING", "RUNNING", True), ("RUNNING", "FAILED", True), ("FAILED", "RUNNING", False)]
    spark.createDataFrame([("c", k, k, True) for k in range(6)], "caller string, call_id long, ts long, failed boolean").coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("caller string, call_id long, ts long, failed boolean").parquet(str(tmp_path / "c"))
    got = tasks.run_to_table(tasks.breaker_states(stream), "breaker").orderBy("call_id").collect()
    assert [r["open"] for r in got] == [False] * 4 + [True] * 2


def test_idempotency_and_sessions(spark):
    rows = spark.createDataFrame([("k", "h", 1), ("k", "h", 2), ("k", "g", 3)], "key string, request_hash string, ord long")
    assert [r["outcome"] for r in tasks.idempotent(rows).orderBy("ord").collect()] == ["created", "duplicate", "conflict"]
    s = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:09:30")], "session_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    live = tasks.live_sessions(s, F.lit("2024-01-01 00:12:00").cast("timestamp"))
    assert [r["session_id"] for r in live.collect()] == ["b"]
