import random
import re

from pyspark.sql import functions as F

from reviewlens.functions.text import glob_regex
from reviewlens.operators import diff, packing

DIFF = """diff --git a/src/A.java b/src/A.java
--- a/src/A.java
+++ b/src/A.java
@@ -10,4 +10,5 @@ class A
 ctx
+add one
-gone
+add two
 end
@@ -30,2 +31,3 @@
 x
+y
diff --git a/B.py b/B.py
--- a/B.py
+++ b/B.py
@@ -0,0 +1,2 @@
+p
+q
"""


def model_line_map(text):
    """A state machine over the lines."""
    out, path, new = [], None, None
    for k, line in enumerate(text.split("\n"), 1):
        if line.startswith("+++ "):
            path, new = re.sub(r"^b/", "", re.sub(r"^a/", "", line[4:].split("\t")[0].rstrip())), None
        elif line.startswith("--- "):
            new = None
        elif line.startswith("@@"):
            m = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", line)
            new = int(m[1]) if m else None
        elif new is not None and (line == "" or line[0] in " +-\\"):
            if line.startswith("+") and path:
                out.append((path, k, new))
            if not line.startswith(("-", "\\")):
                new += 1
        else:
            new = None
    return out


def _lines(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "review_id string, t string")
    return df.select("review_id", F.posexplode(F.split("t", "\n")).alias("pos", "line"))


def test_line_map_equals_the_state_machine(spark):
    rng = random.Random(1)
    texts = {"d": DIFF, "e": ""}
    bits = ["+a", "-b", " c", "", "+++ b/x.java", "--- a/x", "@@ -1,2 +3,4 @@", "@@ -7 +9 @@ f", "@@ bad", "\\ No newline", "junk", "++ d", "+++e"]
    for k in range(60):
        texts[f"r{k}"] = "\n".join(["+++ b/f.py", "@@ -1 +1 @@", *(rng.choice(bits) for _ in range(25))])
    got = {}
    for r in diff.line_map(_lines(spark, texts)).collect():
        got.setdefault(r["review_id"], []).append((r["file_path"], r["diff_line"], r["file_line"]))
    for k, t in texts.items():
        assert sorted(got.get(k, [])) == sorted(model_line_map(t)), t
    assert ("src/A.java", 6, 11) in got["d"] and ("B.py", 17, 1) in got["d"]


def test_changed_lines_and_sections(spark):
    got = sorted(r["file_line"] for r in diff.changed_lines(_lines(spark, {"d": DIFF})).collect())
    assert got == [1, 2, 11, 12, 32]
    s = diff.sections(spark.createDataFrame([("d", DIFF), ("e", "no header")], "diff_id string, diff_text string")).collect()
    assert [(r["diff_id"], r["file_path"]) for r in s] == [("d", "src/A.java"), ("d", "B.py"), ("e", "full-diff")]
    kept = diff.without_excluded(spark.createDataFrame([("d", DIFF)], "diff_id string, diff_text string"), ["src"]).first()["diff_text"]
    assert kept == DIFF[DIFF.index("diff --git a/B.py") :]


def test_changed_lines_that_start_with_a_plus(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -5,9 +5,9 @@\n c\n++1 (976) 555\n+++ two\n+z\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -1 +40,2 @@\n++y\n+z\n--- a/z\n+++ b/z\n@@ -1 +90 @@\n+q"
    changed = lambda **how: sorted(r["file_line"] for r in diff.changed_lines(_lines(spark, {"d": text}), **how).collect())
    assert changed(every=True) == [6, 7, 8, 40, 41, 90]
    assert changed() == [6, 40, 90]


def test_nearest_hunk_is_the_earlier_on_ties(spark):
    heads = diff.hunk_headers(_lines(spark, {"d": DIFF}))
    points = spark.createDataFrame([("d", "src/A.java", k) for k in (1, 4, 7, 8, 99)] + [("d", "none", 1)], "review_id string, file_path string, diff_line int")
    got = {(r["file_path"], r["diff_line"]): r["hunk_start"] for r in diff.nearest_hunk(points, heads).collect()}
    assert got == {("src/A.java", 1): 10, ("src/A.java", 4): 10, ("src/A.java", 7): 10, ("src/A.java", 8): 31, ("src/A.java", 99): 31, ("none", 1): None}


def test_globs():
    cases = [("a.java", "*.java", True), ("src/a.java", "*.java", False), ("src/a.java", "**/*.java", True), ("a.java", "**/*.java", True), ("src/x/a.py", "src/**", True), ("ab.py", "a?.py", True), ("a/b.py", "a?b.py", False), ("a+b(1).py", "a+b(1).py", True), ("src/gen/x", "**/gen/**", True)]
    for path, pattern, want in cases:
        assert bool(re.match(glob_regex(pattern), path)) == want, (path, pattern)


def test_pull_request_specs(spark):
    df = spark.createDataFrame([("o/r.x#12",), ("bad",), (" a/b#1 ",)], "s string")
    assert [r[0] and tuple(r[0]) for r in df.select(diff.pull_request(F.col("s"))).collect()] == [("o", "r.x", 12), None, ("a", "b", 1)]


def test_packing_keeps_entries_and_limits(spark):
    rng = random.Random(5)
    rows = [("r", k, f"f{k}", "x" * rng.randint(1, 30_000), rng.choice([0, 0, 6200])) for k in range(60)] + [("s", k, f"g{k}", "x" * 100, 0) for k in range(10)]
    got = packing.chunks(spark.createDataFrame(rows, "review_id string, ord long, file_path string, content string, token_count int")).collect()
    assert len(got) == 70 and {r["chunk"] for r in got if r["review_id"] == "s"} == {0}
    by = {}
    for r in got:
        by.setdefault((r["review_id"], r["chunk"]), []).append(r)
    for part in by.values():
        assert len(part) <= 10 and sum(r["chars"] for r in part) <= 60_000 and sum(r["tokens"] for r in part) <= 12_000


def test_least_filled_first():
    assert packing.pack_list([(10, 8), (10, 5), (10, 3), (10, 3)], 3, 100, 12, 9) == [0, 1, 1, 0]
    assert packing.pack_list([(1, 1)] * 5, 2, 100, 100, 90) == [0, 0, 1, 1, 2]


def test_split_hunks_keep_every_added_line():
    body = "".join(random.Random(k).choice([" c", "+a", "-d"]) + f"{k}\n" for k in range(60))
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -5,9 +7,9 @@ f\n" + body
    want = {(t, n) for _, n, t in [(0, f, text.split("\n")[k - 1]) for _, k, f in model_line_map(text)]}
    for most in (45, 55, 120):
        pieces = packing.split_entry(text, 0, most + 40, 10_000)
        assert len(pieces) > 1
        got = {(p.split("\n")[k - 1], f) for p in pieces for _, k, f in model_line_map(p)}
        assert got == want
    assert packing.split_entry("short", 1) == ["short"] and packing.split_entry("y" * 70_000, 1) == ["y" * 70_000]


def test_next_fit(spark):
    df = spark.createDataFrame([("r", k, f"f{k}", t) for k, t in enumerate([5000, 900, 200, 7000, 1, 5999])], "review_id string, ord long, file_path string, tokens long")
    assert [r["bin"] for r in packing.next_fit(df).orderBy("ord").collect()] == [0, 0, 1, 2, 3, 3]
