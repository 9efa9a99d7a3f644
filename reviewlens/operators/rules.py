"""Deterministic rule scan: one pass over lines, every rule an expression, one row for each hit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.diff import scanned

# The patterns that decide what a rule finds.
SQL_CONCAT = r"""(?i)("\s*\+\s*\w+.*(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE))|((?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE).*\+\s*")"""
SECRET_ASSIGNMENT = r"""(?i)(password|passwd|secret|api_key|apikey|token|private_key)\s*[:=]\s*["'][^"']{8,}["']"""
CLOUD_KEY = r"AKIA[0-9A-Z]{16}"
HOST_TOKEN = r"gh[ps]_[A-Za-z0-9_]{36,}"
ADDED_SQL = r"""(?i)(String\.format.*SELECT|String\.format.*INSERT|String\.format.*UPDATE|String\.format.*DELETE|executeQuery\s*\(\s*"|statement\.execute\s*\(\s*"|\+\s*"?\s*(SELECT|INSERT|UPDATE|DELETE)\s)"""
ADDED_SECRET = r"""(?i)(password\s*=\s*"[^"]+"|api_?key\s*=\s*"[^"]+"|secret\s*=\s*"[^"]+"|token\s*=\s*"[^"]{16,}")"""
ADDED_DANGER = r"(?i)(Runtime\.getRuntime\(\)|ProcessBuilder|Thread\.sleep\s*\(\s*\d{5,}|System\.exit\s*\(|eval\s*\(|exec\s*\(|subprocess\.call|os\.system)"
ADDED_COMPLEXITY = r"(?i)(if\s*\(.*&&.*&&.*&&|if\s*\(.*\|\|.*\|\|.*\|\||for\s*\(.*for\s*\(.*for\s*\()"
MOST_INDENT = 24
#: The line of a unified diff that names the new file.
FILE_HEADER = r"^\+\+\+ (?:\"?[ab]/|/dev/null)"


def is_added(line: Column) -> Column:
    """F1."""
    return line.startswith("+") & ~line.startswith("+++")


def without_marker(line: Column) -> Column:
    """the code of a diff line; null for metadata and removed lines; context lines as they are."""
    meta = line.startswith("-") | line.startswith("+++") | line.startswith("@@") | line.startswith("diff ") | line.startswith("index ") | line.startswith("\\ ")
    return F.when(meta, F.lit(None)).when(line.startswith("+"), F.substr(line, F.lit(2))).otherwise(line)


def is_java_or_python(path: Column) -> Column:
    """F3."""
    return path.endswith(".java") | path.endswith(".py")


@dataclass(frozen=True)
class Rule:
    """A rule over the columns ``file_path``, ``line`` (raw), ``code`` (trimmed, without marker), ``added`` (without +)."""

    name: str
    hit: Column
    type: str
    severity: str
    message: str
    suggestion: str = ""


def default_rules() -> list[Rule]:
    """R1-R3 over context and added lines of the gateway's scan, R5-R8 over added lines of the agent's."""
    code, added, either = F.col("code"), F.col("added"), is_java_or_python(F.col("file_path"))
    return [
        Rule("R1", either & code.rlike(SQL_CONCAT), "sql_injection", "WARNING", "SQL text is concatenated with a value.", "Bind parameters."),
        Rule("R2", code.rlike(SECRET_ASSIGNMENT) | code.rlike(CLOUD_KEY) | code.rlike(HOST_TOKEN), "hardcoded_secret", "WARNING", "A secret or key is written into the code.", "Read it from the environment or a secret store."),
        Rule("R3a", either & code.contains("exec("), "command_injection", "WARNING", "A command is executed.", "Pass arguments as a list."),
        Rule("R3b", either & code.contains("ObjectInputStream") & ~code.contains("ValidatingObjectInputStream"), "insecure_deserialization", "WARNING", "Objects are read without validation.", "Filter the classes that may be read."),
        Rule("R5", added.rlike(ADDED_SQL), "sql_injection", "WARNING", "An added line builds SQL from strings."),
        Rule("R6", added.rlike(ADDED_SECRET), "hardcoded_secret", "CRITICAL", "An added line holds a secret."),
        Rule("R7", added.rlike(ADDED_DANGER), "dangerous_function", "WARNING", "An added line calls a dangerous function."),
        Rule("R8", added.rlike(ADDED_COMPLEXITY), "complexity", "INFO", "An added line is complex."),
    ]


def scan(lines: DataFrame, rules: list[Rule] | None = None, diff: bool = False) -> DataFrame:
    """``lines`` (``review_id``, ``file_path``, ``pos`` from 0, ``line``) to issues.

    A line gives a row for each rule that it hits. Every rule is evaluated in the same projection, so
    the lines are read once and nothing is shuffled. ``diff``: every line is one of a unified diff, so its first
    character alone is its marker, and a context or added line may itself start with a marker; else lines are trimmed
    before their marker is looked for, as files' lines have none.
    """
    rules = default_rules() if rules is None else rules
    line = F.col("line")
    if diff:
        header = line.rlike(FILE_HEADER)
        code = F.when(~header & (line.startswith("+") | line.startswith(" ") | (line == "")), F.substr("line", F.lit(2)))
        seen = lines.withColumn("code", F.regexp_replace(code, r"^\s+|\s+$", "")).withColumn("added", F.when(~header & line.startswith("+"), F.substr("line", F.lit(2))))
    else:
        seen = lines.withColumn("code", without_marker(F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))).withColumn("added", F.when(is_added(line), F.substr("line", F.lit(2))))
    fields = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(r.suggestion).alias("suggestion"))
    hits = F.filter(F.array(*[F.when(F.coalesce(r.hit, F.lit(False)), fields(r)) for r in rules]), lambda x: x.isNotNull())
    hit = seen.withColumn("hit", F.explode(hits))
    return hit.select("review_id", F.col("file_path").alias("file"), (F.col("pos") + 1).cast("int").alias("line"), "hit.rule", "hit.type", "hit.severity", "hit.message", "hit.suggestion")


def deepest_indent(lines: DataFrame, most: int = MOST_INDENT) -> DataFrame:
    """For each Java file deeper than ``most``, its greatest indent and the first line that reaches it.

    A space counts 1, a tab 4; lines aren't trimmed. The maximum of (indent, -position) is one
    partial aggregate for each file.
    """
    code = without_marker(F.col("line"))
    lead = F.regexp_extract(code, r"^[ \t]*", 0)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    java = lines.where(F.col("file_path").endswith(".java")).where(code.isNotNull())
    deepest = java.groupBy("review_id", "file_path").agg(F.max(F.struct((F.length(lead) + 3 * tabs).alias("indent"), (-F.col("pos")).alias("at"))).alias("m"))
    return deepest.where(F.col("m.indent") > most).select("review_id", F.col("file_path").alias("file"), F.col("m.indent").cast("int").alias("indent"), (1 - F.col("m.at")).cast("int").alias("line"), F.lit("high_nesting_depth").alias("type"), F.lit("WARNING").alias("severity"))


def with_current_file(lines: DataFrame) -> DataFrame:
    """``current_file``, the path of the last ``+++ b/`` line at or before each line of its diff."""
    out = scanned(lines, "review_id", "pos", F.lit(0), _path=(F.col("line").startswith("+++ b/"), F.substr("line", F.lit(7))))
    return out.withColumn("current_file", F.col("_path.value")).drop("_path", "_total")
