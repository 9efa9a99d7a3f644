"""Many seeds, two-ended paths, open bins, table functions, indexes and streams, against plain Python."""

import random
from collections import deque

import pytest

from reviewlens.operators import graph, packing

EDGE = "src string, dst string, type string, line int"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "CALLS", k) for k, (a, b) in enumerate(pairs)] + [("n0", "n1", "CONTAINS", -1)], EDGE)


def some_pairs(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


def test_impact_of_more_seeds_than_a_word_has_bits(spark):
    pairs = some_pairs(1, 150, 300)
    seeds = [f"n{k}" for k in range(0, 150, 2)] + ["nowhere"]
    got = {(r.seed, r.id): r.depth for r in graph.impact_of_many(edges_of(spark, pairs), spark.createDataFrame([(s,) for s in seeds + seeds[:3]], "id string"), 3).collect()}
    want = {}
    for s in seeds:
        near, depth = {s: 0}, deque([s])
        while depth:
            x = depth.popleft()
            for a, b in pairs:
                if b == x and a not in near and near[x] < 3:
                    near[a] = near[x] + 1
                    depth.append(a)
        want |= {(s, x): d for x, d in near.items() if d}
    assert got == want
    assert graph.impact_of_many(edges_of(spark, pairs), spark.createDataFrame([], "id string"), 2).count() == 0
    assert graph.impact_of_many(edges_of(spark, pairs), spark.createDataFrame([("n1",)], "id string"), 0).count() == 0


def first_path(pairs, start, goal):
    """Of all shortest paths the one whose nodes come first."""
    best, level = None, [[start]]
    seen = {start}
    while level and best is None:
        grown = [[*p, b] for p in level for a, b in pairs if a == p[-1] and b not in seen]
        ends = [p for p in grown if p[-1] == goal]
        best = min(ends) if ends else None
        seen |= {p[-1] for p in grown}
        level = grown
    return best


def test_paths_from_both_ends(spark):
    pairs = some_pairs(2, 40, 70)
    edges = edges_of(spark, pairs).where("type = 'CALLS'")
    for start, goal in (("n0", "n7"), ("n3", "n21"), ("n5", "n5"), ("n1", "nowhere")):
        want = [] if start == goal else first_path(pairs, start, goal) or []
        got = graph.shortest_path(edges, start, goal).orderBy("step").collect()
        assert [(r.src, r.dst) for r in got] == list(zip(want, want[1:], strict=False))


def test_a_wide_end_is_left_to_the_other(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(5)]
    fan = [("c0", f"x{k}") for k in range(300)] + [(f"y{k}", "c5") for k in range(3)]
    got = graph.shortest_path(edges_of(spark, chain + fan), "c0", "c5").orderBy("step").collect()
    assert [(r.src, r.dst) for r in got] == chain


def plain_pack(items, most_files, most_chars, most_tokens, soft):
    """The least filled bin under the soft target that holds the item, else the least filled one that does, else a new one."""
    bins, out = [], []
    for chars, tokens in items:
        fits = [(t >= soft, t, k) for k, (t, c, n) in enumerate(bins) if n < most_files and c + chars <= most_chars and t + tokens <= most_tokens]
        k = min(fits)[2] if fits else len(bins)
        if not fits:
            bins.append((0, 0, 0))
        t, c, n = bins[k]
        bins[k] = (t + tokens, c + chars, n + 1)
        out.append(k)
    return out


@pytest.mark.parametrize("width", [1, 2, 256])
def test_open_bins_choose_as_a_search_of_all(monkeypatch, width):
    monkeypatch.setattr(packing.OpenBins, "WIDTH", width)
    rng = random.Random(width)
    for _ in range(60):
        items = sorted(((rng.randint(0, 70), rng.randint(0, 40)) for _ in range(rng.randint(0, 120))), key=lambda x: -max(x[0], 4 * x[1]))
        assert packing.pack_list(items, 4, 100, 60, 45) == plain_pack(items, 4, 100, 60, 45)


def test_a_review_of_many_entries_is_packed_in_seconds():
    import time

    rng = random.Random(9)
    items = sorted(((rng.randint(1, 30_000), rng.randint(1, 6_000)) for _ in range(200_000)), key=lambda x: -max(x[0], 4 * x[1]))
    begun = time.perf_counter()
    bins = packing.pack_list(items, 10, 60_000, 12_000, 9_000)
    assert len(bins) == 200_000 and time.perf_counter() - begun < 60


def test_parts_of_an_entry_are_rows(spark):
    body = "".join(f"+line {k}\n" for k in range(40))
    whole = f"diff --git a/x b/x\n@@ -1,0 +1,40 @@\n{body}@@ -50,1 +90,1 @@\n x\n"
    rows = [("r", 1, "a", whole, 0), ("r", 2, "b", "short", 7), ("r", 3, "c", "z" * 300, 0), ("r", 4, "d", None, None)]
    entries = spark.createDataFrame(rows, "review_id string, ord long, file_path string, content string, token_count int")
    got = packing.split_oversized(entries, 120, 1000).orderBy("ord", "part").collect()
    parts = packing.split_entry(whole, 1, 120, 1000)
    assert len(parts) > 3 and [r.content for r in got if r.ord == 1] == parts and [r.part for r in got if r.ord == 1] == list(range(len(parts)))
    assert [(r.content, r.token_count) for r in got if r.ord == 2] == [("short", 7)]
    assert [r.content for r in got if r.ord == 3] == ["z" * 300]


def test_an_index_finds_what_a_full_search_finds(spark, monkeypatch):
    from reviewlens.operators import retrieval

    monkeypatch.setattr(retrieval.TermIndex, "BLOCK", 8)
    monkeypatch.setattr(retrieval.TermIndex, "FIRST", 2)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, [1 / (1 + (i - k % 6 * 10) % 60) for i in range(60)], k=30))) for k in range(600)]
    docs += [(600 + k, docs[5][1]) for k in range(40)] + [(700, None), (701, "")]
    weights = retrieval.weighed(spark.createDataFrame(docs, "doc_id long, text string"))[1].cache()
    index = retrieval.TermIndex(weights)
    for d, k in ((5, 10), (17, 1), (3, 60), (44, 1000)):
        query = weights.where(weights.doc_id == d).select("term", "weight")
        got, want = index.search(query, k).collect(), retrieval.search_terms(weights, query, k).collect()
        assert [(r.doc_id, round(r.score, 9)) for r in got] == [(r.doc_id, round(r.score, 9)) for r in want]
    index.search(weights.where("doc_id = 5").select("term", "weight"), 10).collect()
    read, there = index.reads()
    assert 0 < read < 0.7 * there
    assert index.search(weights.where("doc_id = -1").select("term", "weight"), 3).count() == 0


def test_many_queries_meet_only_near_cells_and_miss_nothing(spark, monkeypatch):
    import numpy as np

    from reviewlens.operators import retrieval

    monkeypatch.setattr(retrieval.VectorIndex, "CELL", 40)
    monkeypatch.setattr(retrieval.VectorIndex, "QUERIES", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([centres[k % 6] / np.linalg.norm(centres[k % 6]) + 0.02 * rng.normal(size=8) for k in range(300)] + [np.tile(centres[0], 150)]).reshape(-1, 8)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0, 0.0]), (902, [0.5, 2.0]), (903, [1.0, None]), (904, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = retrieval.VectorIndex(table)
    got = {}
    for r in index.search(table.where("vec_id % 10 = 0 or vec_id > 899"), 7).collect():
        got.setdefault(r["query"], []).append((r["nth"], r["id"], round(r["score"], 9)))
    valid = [(i, v) for i, v in rows if v is not None and None not in v]
    want = {}
    for i, q in valid:
        if i % 10 == 0 or i > 899:
            near = sorted((-round(float(np.dot(q, v)), 9), j) for j, v in valid if len(v) == len(q))[:7]
            want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(near)]
    assert {k: sorted((n, j) for n, j, _ in v) for k, v in got.items()} == {k: [(n, j) for n, j, _ in v] for k, v in want.items()}
    assert index.left.count() < 0.5 * index.bounds.count()


def test_ranges_that_hold_a_changed_line(spark):
    from reviewlens.operators import diff

    rng = random.Random(6)
    changed = [(f"d{k % 5}", rng.randint(1, 40)) for k in range(30)]
    ranges = [(f"d{k % 7}", s, s + rng.randint(-1, 4), k) for k in range(200) for s in [rng.randint(1, 45)]] + [("d1", 3, None, -1), ("d6", None, None, -2)]
    got = diff.overlapping(spark.createDataFrame(ranges, "review_id string, start_line int, end_line int, k int"), spark.createDataFrame([*changed, ("d6", None)], "review_id string, file_line int"))
    assert got.columns == ["review_id", "start_line", "end_line", "k"]
    lines = {d: {n for e, n in changed if e == d} for d, _ in changed}
    want = sorted(k for d, s, e, k in ranges if d not in lines or s is not None and e is not None and any(s <= n <= e for n in lines[d]))
    assert sorted(r.k for r in got.collect()) == want


def some_diff(rng, n):
    heads = ["--- a/x", "+++ b/src/A.java", "+++ a/b.py\t2024", "+++ /dev/null", "@@ -3,4 +7,5 @@ f", "@@ -1 +2 @@", "@@ -9,2 +30,1", "@@ odd", "diff --git a/q b/q", "\\ No newline"]
    return "\n".join(rng.choice(heads) if rng.random() < 0.2 else rng.choice("+- +") + rng.choice(["", "+", "line", "-x"]) if rng.random() < 0.95 else "" for _ in range(n))


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_scans_of_blocks_are_scans_of_the_whole(spark, monkeypatch, block):
    import re

    from reviewlens.operators import diff, rules
    from tests.test_diff_packing import _lines, model_line_map

    monkeypatch.setattr(diff, "BLOCK", block)
    rng = random.Random(block)
    texts = {f"d{k}": some_diff(rng, rng.randint(0, 60)) for k in range(12)} | {None: some_diff(rng, 20)}
    lines = _lines(spark, texts).cache()
    got, headers, paths, changed = {}, {}, {}, {}
    for r in diff.line_map(lines).collect():
        got.setdefault(r["review_id"], []).append((r["file_path"], r["diff_line"], r["file_line"]))
    heads = diff.hunk_headers(lines).cache()
    for r in heads.collect():
        headers.setdefault(r["review_id"], []).append((r["header_line"], r["file_path"], r["new_start"]))
    for r in rules.with_current_file(lines).collect():
        paths[r["review_id"], r["pos"]] = r["current_file"]
    for r in diff.changed_lines(lines).collect():
        changed.setdefault(r["review_id"], set()).add(r["file_line"])
    points = [(d, p, k) for d, t in texts.items() for p in ("src/A.java", "b.py\t2024", "none") for k in range(1, len(t.split("\n")) + 3)]
    near = {(r["review_id"], r["file_path"], r["diff_line"]): r["hunk_start"] for r in diff.nearest_hunk(spark.createDataFrame(points, "review_id string, file_path string, diff_line int"), heads).collect()}
    assert len(near) == len(points)
    for d, text in texts.items():
        assert sorted(got.get(d, [])) == sorted(model_line_map(text))
        file, want, s = None, [], None
        for k, line in enumerate(text.split("\n")):
            if line.startswith("+++ b/"):
                file = line[6:]
            assert paths[d, k] == file
        file = None
        for k, line in enumerate(text.split("\n"), 1):
            if line.startswith("+++ "):
                file = re.sub("^b/", "", re.sub("^a/", "", line[4:]))
            m = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", line)
            if m and file is not None:
                want.append((k, file, int(m[1])))
        assert sorted(headers.get(d, [])) == want
        lines_of, s = set(), None
        for line in text.split("\n"):
            m = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)
            if m:
                s, n, seen = int(m[1]), int(m[2] or 1), 0
            elif s is not None and (line.startswith(" ") or line.startswith("+") and not line.startswith("++")):
                if line[0] == "+" and seen < n:
                    lines_of.add(s + seen)
                seen += 1
        assert changed.get(d, set()) == lines_of
        for p in ("src/A.java", "b.py\t2024", "none"):
            own = [(k, n) for k, f, n in want if f == p]
            for k in range(1, len(text.split("\n")) + 3):
                assert near[d, p, k] == (min(own, key=lambda h: (abs(h[0] - k), h[0]))[1] if own else None)


def test_one_diff_is_scanned_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from reviewlens.operators import diff

    n = 1_200_000
    line = F.when(F.col("id") == 0, "+++ b/x").when(F.col("id") == 1, "@@ -1,1 +1,9 @@").when(F.col("id") % 3 == 0, "-old").otherwise("+new")
    out = diff.line_map(spark.range(n).select(F.lit("d").alias("review_id"), F.col("id").alias("pos"), line.alias("line")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = out.agg(F.count(F.lit(1)), F.max("file_line"), F.sum("file_line")).first()
    added = n - 2 - len(range(3, n, 3))
    assert tuple(got) == (added, added, added * (added + 1) // 2)


def _fed(spark, tmp_path, frames, make):
    """The rows of a stream over files that come one after the other, a batch each."""
    from reviewlens.streaming import tasks

    folder = str(tmp_path / "in")
    for k, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return tasks.run_to_table(make(stream), "fed").collect()


def test_dead_letters_by_timer(spark, tmp_path):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from reviewlens.streaming import tasks

    begin = datetime(2024, 1, 1)
    rng = random.Random(8)
    created = {f"m{k}": rng.randint(0, 90) for k in range(60)}
    taken = {m: t + rng.choice([1, 5, 9]) for m, t in created.items() if rng.random() < 0.4}
    rows = [(m, f"q{int(m[1:]) % 3}", begin + timedelta(minutes=t), False) for m, t in created.items()] + [(m, f"q{int(m[1:]) % 3}", begin + timedelta(minutes=t), True) for m, t in taken.items()]
    schema = "message_id string, queue string, ts timestamp, taken boolean"
    parts = [[r for r in rows if lo <= (r[2] - begin).seconds // 60 < lo + 25] for lo in (0, 25, 50, 75)]
    got = _fed(spark, tmp_path, [spark.createDataFrame(p, schema) for p in parts if p], lambda s: tasks.dead_letters(s, "queue"))
    last = max(r[2] for r in rows)
    want = sorted(m for m, t in created.items() if m not in taken and begin + timedelta(minutes=t + 10) <= last)
    assert sorted(r.message_id for r in got) == want
    assert all(r.died_at == begin + timedelta(minutes=created[r.message_id] + 10) for r in got)


def test_conflicts_over_several_batches(spark, tmp_path):
    from reviewlens.streaming import tasks

    from datetime import datetime, timedelta

    schema = "key string, request_hash string, ord long, ts timestamp"
    batches = [[("a", "x", 1), ("b", "y", 2), ("a", "x", 3)], [("a", "z", 4), ("c", None, 5), ("b", "y", 6)], [("c", None, 7), ("c", "w", 8), ("a", "x", 9), ("b", None, 10)], [("d", "q", 11)], [("a", "new", 12)], [("a", "x", 13)]]
    # the eleventh comes a day later, after which the key's first request no longer counts
    at = lambda n: datetime(2024, 1, 1) + timedelta(minutes=n, days=n > 10)
    got = _fed(spark, tmp_path, [spark.createDataFrame([(*r, at(r[2])) for r in b], schema) for b in batches], lambda s: tasks.idempotent_stream(s, 60))
    want = {1: "created", 2: "created", 3: "duplicate", 4: "conflict", 5: "created", 6: "duplicate", 7: "duplicate", 8: "conflict", 9: "duplicate", 10: "conflict", 11: "created"}
    outcome = {r.ord: r.outcome for r in got}
    assert len(got) == 13 and {k: outcome[k] for k in want} == want
    # the timer goes off with the batch that brings the twelfth or before
    assert (outcome[12], outcome[13]) in (("created", "conflict"), ("conflict", "created"))


def test_tokens_need_neither_translation_nor_filter(spark):
    """As before, tokens of two characters or more between underscores and punctuation; found by the expression alone."""
    import re

    from pyspark.sql import functions as F

    from reviewlens.functions.text import code_tokens

    rng = random.Random(6)
    texts = ["", "a", "_", "1a2", "HTTPServer_x1", "aB", "12ab_34", "x-y.z", "\u0130I_K\u212a2 \u00e9a1", *("".join(rng.choice("aAbB1_2 -.\u00e9Z") for _ in range(rng.randrange(30))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")

    split = F.regexp_replace(F.regexp_replace("t", r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    plain = F.regexp_extract_all(F.lower(F.translate(split, "_{}()[];,.<>!=+-*/&|?:@#~\"'", " " * 27)), F.lit(r"[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+"), F.lit(0))
    rows = docs.select("t", code_tokens(F.col("t")).alias("got"), F.filter(plain, lambda x: F.length(x) > 1).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and any(len(r["got"]) > 3 for r in rows)
    assert not re.search("translate|filter|lambda", docs.select(code_tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower())
