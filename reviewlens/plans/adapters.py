"""The driver's tables in this domain's shapes, as DataFrames and, told apart, as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.functions import severity as sev
from reviewlens.functions.text import estimated_tokens

#: Messages for issues; an event's number picks one. Several match an exclusion rule.
MESSAGES = (
    "Query text is built from input",
    "Potential denial of service in the loop",
    "Consider adding rate limit to the endpoint",
    "Null value may reach the caller",
    "Buffer overflow when copying the name",
    "Please follow best practices here",
    "Open redirect after login",
    "Race between two writers",
    "Consider using caching for the list",
    "Secret is hardcoded in the client",
    "Regex injection by the search field",
    "Name of the method says little",
)
ENDINGS = (".java", ".py", ".md", ".cpp", "Test.java", ".ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: review by source, path by source, number and language."""
    ext = F.when(F.col("lang") == "en", ".java").when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", ".ts").otherwise(".md")
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("review_id"), F.col("doc_id").alias("ord"), F.concat("source", F.lit("/"), F.col("doc_id"), ext).alias("file_path"), text.alias("content"), estimated_tokens(text).cast("int").alias("token_count"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as unified diffs: a hunk every ten lines; of every four lines one is context, one removed, two added."""
    f = files(spark, sf_dir)
    mark = lambda x, i: F.concat(F.when(i % 4 == 0, " ").when(i % 4 == 3, "-").otherwise("+"), x)
    head = lambda i: F.concat(F.lit("@@ -"), i + 1, F.lit(",10 +"), i + 1, F.lit(",10 @@"))
    body = F.flatten(F.transform(F.split("content", "\n"), lambda x, i: F.when(i % 10 == 0, F.array(head(i), mark(x, i))).otherwise(F.array(mark(x, i)))))
    text = F.concat(F.lit("diff --git a/"), "file_path", F.lit(" b/"), "file_path", F.lit("\n--- a/"), "file_path", F.lit("\n+++ b/"), "file_path", F.lit("\n"), F.array_join(body, "\n"))
    return f.select("review_id", F.col("file_path").alias("diff_id"), "file_path", "ord", text.alias("diff_text"))


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs(spark, sf_dir).select("diff_id", F.posexplode(F.split("diff_text", "\n")).alias("pos", "line"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues."""
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "Medium").when(F.col("event_type") == "view", "odd").otherwise("INFO")
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), k % len(MESSAGES) + 1)
    noisy = F.when(F.col("event_id") % 3 == 0, F.upper(text)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("   ")))).otherwise(text)
    ext = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("user_id") % len(ENDINGS) + 1).cast("int"))
    return e.select(
        F.concat(F.lit("r"), F.col("user_id") % 7).alias("review_id"),
        F.col("event_id").alias("ord"),
        raw.alias("raw_severity"),
        sev.normal(raw).alias("severity"),
        F.concat(F.lit("src/u"), "user_id", ext).alias("file"),
        F.when(F.col("event_id") % 5 != 0, F.floor("value").cast("int")).alias("line"),
        F.col("event_type").alias("type"),
        noisy.alias("message"),
        F.when(F.col("event_id") % 2 == 0, "Check it.").otherwise("").alias("suggestion"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of an order, as calls."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst is not null").select(F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"), F.lit("CALLS").alias("type"), F.lit(-1).alias("line"))


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and suppliers as a containment graph: nodes and edges."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = lambda d, p, k, name, t: d.select(F.concat(F.lit(p), k).alias("id"), F.lit(t).alias("type"), F.col(name).alias("name"))
    nodes = node(r, "r", "r_regionkey", "r_name", "FILE").unionByName(node(n, "n", "n_nationkey", "n_name", "CLASS")).unionByName(node(s, "s", "s_suppkey", "s_name", "METHOD"))
    edge = lambda d, a, b: d.select(a.alias("src"), b.alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(-1).alias("line"))
    edges = edge(n, F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")).unionByName(edge(s, F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    return nodes, edges


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recorded calls; errors failed."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("caller"), F.col("event_id").alias("call_id"), "ts", (F.col("event_type") == "error").alias("failed"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as task transitions."""
    t = F.col("event_type")
    status = F.when(t == "signup", "PENDING").when(t.isin("click", "view"), "RUNNING").when(t == "purchase", "COMPLETED").otherwise("FAILED")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("t"), "user_id").alias("task_id"), "event_id", "ts", status.alias("status"))


def _case(values: tuple[str, ...], index: str) -> str:
    return "(list_value(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"))[{index}]"


V_FILES = """v_files as (select source as review_id, doc_id as ord, source || '/' || doc_id || case lang when 'en' then '.java' when 'fr' then '.py' when 'de' then '.ts' else '.md' end as file_path,
 coalesce(text, '') as content, greatest(1, length(coalesce(text, '')) // 4)::int as token_count from documents)"""
#: Lines of the files with their place; a diff's lines follow from them by arithmetic.
V_LINES = V_FILES + """, v_lines as (select review_id, file_path, p - 1 as p, lines[p] as x from (select review_id, file_path, string_split(content, chr(10)) as lines, unnest(range(1, len(string_split(content, chr(10))) + 1)) as p from v_files))"""
V_ISSUES = f"""v_issues as (select 'r' || (user_id % 7) as review_id, event_id as ord,
 case event_type when 'error' then 'CRITICAL' when 'purchase' then 'CRITICAL' when 'signup' then 'WARNING' else 'INFO' end as severity,
 'src/u' || user_id || {_case(ENDINGS, f"user_id % {len(ENDINGS)} + 1")} as file, case when event_id % 5 <> 0 then floor(value)::int end as line, event_type as type,
 case event_id % 3 when 0 then upper(m) when 1 then '  ' || replace(m, ' ', '   ') else m end as message, case when event_id % 2 = 0 then 'Check it.' else '' end as suggestion, m as plain
 from (select *, {_case(MESSAGES, f"(props->>'k')::int % {len(MESSAGES)} + 1")} as m from events))"""
V_EDGES = """v_edges as (select 'p' || a as src, 'p' || b as dst from (select l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as b from lineitem) where b is not null)"""
