"""False-positive exclusion: ordered rules compiled into one conditional expression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import basename, extension

# What the default rules match, in the order in which they are tried.
DOCUMENTS = (".md", ".txt", ".rst", ".adoc", ".tex", ".org")
TEST_ENDINGS = ("Test.java", "Tests.java", "Spec.java", "IT.java", "_test.py", "test_", "Test.kt", "Tests.kt", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx")
NATIVE = (".c", ".cc", ".cpp", ".h", ".hpp")
BROWSER = (".js", ".ts", ".tsx", ".jsx")
DEFAULT_TEXT = (
    (
        "Generic DOS/resource exhaustion finding",
        (r"potential\s+denial\s+of\s+service", r"dos\s+attack", r"resource\s+exhaustion", r"exhaust|overwhelm|overload\s+(?:resource|memory|cpu)", r"unbounded\s+(?:growth|loop|recursion)"),
    ),
    ("Generic rate limiting suggestion", (r"consider\s+adding\s+rate\s+limit", r"implement\s+rate\s+limit", r"missing\s+rate\s+limit", r"no\s+rate\s+limit")),
    (
        "Generic performance suggestion without specifics",
        (r"consider\s+(?:adding|using|implementing)\s+(?:a\s+)?caching", r"add\s+(?:a\s+)?caching\s+layer", r"consider\s+(?:using|adding)\s+connection\s+pool", r"use\s+(?:a\s+)?connection\s+pool"),
    ),
    (
        "Memory safety finding in non-C/C++ code",
        (r"buffer\s+overflow", r"use[\s-]?after[\s-]?free", r"double[\s-]?free", r"stack\s+overflow", r"heap\s+overflow", r"out[\s-]?of[\s-]?bounds\s+(?:read|write|access)", r"integer\s+overflow", r"memory\s+(?:corruption|safety)"),
    ),
    ("Open redirect vulnerability (low impact)", (r"\b(open redirect|unvalidated redirect)\b",)),
    ("SSRF in client-side code", (r"\b(ssrf|server\s+.?side\s+.?request\s+.?forgery)\b",)),
    ("Regex injection finding", (r"\b(regex|regular expression)\s+injection\b", r"\b(regex|regular expression)\s+denial of service\b")),
    (
        "Overly generic suggestion without actionable specifics",
        (r"follow\s+best\s+practices?", r"improve\s+code\s+quality", r"consider\s+refactoring", r"follow\s+(?:coding|code)\s+standards?", r"this\s+(?:code|method|function)\s+could\s+be\s+improved", r"add\s+(?:more\s+)?(?:comments|documentation)"),
    ),
)


@dataclass(frozen=True)
class Exclusions:
    """An ordered list: document extensions, (test pattern, reason), (text pattern, reason)."""

    documents: tuple[str, ...] = DOCUMENTS
    tests: tuple[tuple[str, str], ...] = tuple((re.escape(e) + "$", "Finding in test file") for e in TEST_ENDINGS)
    texts: tuple[tuple[str, str], ...] = field(default=tuple((p, d) for d, ps in DEFAULT_TEXT for p in ps))

    def with_rules(self, rules: list[dict]) -> Exclusions:
        """Loaded rules go before the defaults; patterns that don't compile are left out."""
        texts, tests, documents = [], [], list(self.documents)
        for rule in rules:
            reason = rule.get("description", "")
            texts += [(p, reason) for p in rule.get("patterns", ()) if _compiles(p)]
            for spec in rule.get("applies_to_files", ()):
                documents += [e.lower() for e in spec.get("extensions", ()) if e.startswith(".")]
                tests += [(p, reason) for p in spec.get("patterns", ()) if _compiles(p)]
        return Exclusions(tuple(dict.fromkeys(documents)), (*tests, *self.tests), (*texts, *self.texts))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _by_reason(patterns: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """Consecutive patterns of one reason as one alternation, which keeps the CASE small enough for generated code."""
    out: list[tuple[list[str], str]] = []
    for pattern, why in patterns:
        if out and out[-1][1] == why:
            out[-1][0].append(pattern)
        else:
            out.append(([pattern], why))
    return [("(?i)(?:" + "|".join(f"(?:{p})" for p in ps) + ")", why) for ps, why in out]


def reason(rules: Exclusions, file: Column, type_: Column, message: Column, suggestion: Column) -> Column:
    """F9-F13, AGG8: the reason of the first rule that matches, or null.

    One CASE, evaluated until a branch holds: documents, test paths, texts in order. Memory-safety
    reasons don't hold for C and C++ files, where the search goes on.
    """
    path = F.coalesce(file, F.lit(""))
    ext, name = extension(path), F.lower(basename(path))
    text = F.lower(F.concat_ws(" ", F.coalesce(type_, F.lit("")), F.coalesce(message, F.lit("")), F.coalesce(suggestion, F.lit(""))))
    out = F.when(ext.isin(*rules.documents), "Finding in documentation file")
    for pattern, why in _by_reason(rules.tests):
        out = out.when(name.rlike(pattern) | path.rlike(pattern), why or "Finding in test file")
    for pattern, why in _by_reason(rules.texts):
        hit = text.rlike(pattern)
        out = out.when(hit & ~ext.isin(*NATIVE) if "memory safety" in why.lower() else hit, why)
    for pattern in dict(DEFAULT_TEXT)["SSRF in client-side code"]:
        out = out.when(ext.isin(*BROWSER) & text.rlike(pattern), "SSRF in client-side code (not exploitable)")
    return out


def mark(issues: DataFrame, rules: Exclusions | None = None) -> DataFrame:
    """Adds ``filter_metadata`` (excluded, reason, stage); excluded rows keep their place and get confidence 0."""
    why = reason(rules or Exclusions(), F.col("file"), F.col("type"), F.col("message"), F.col("suggestion"))
    out = issues.withColumn("_why", why)
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in issues.columns else F.lit(1.0)
    meta = F.struct(F.col("_why").isNotNull().alias("excluded"), F.col("_why").alias("reason"), F.when(F.col("_why").isNotNull(), "hard_rule").alias("stage"))
    return out.withColumn("confidence", F.when(F.col("_why").isNotNull(), 0.0).otherwise(confidence)).withColumn("filter_metadata", meta).drop("_why")


def mark_by_confidence(issues: DataFrame, least: float) -> DataFrame:
    """rows under the threshold are marked, not deleted."""
    low = ~excluded() & (F.col("confidence") < least)
    old = F.col("filter_metadata")
    meta = F.struct((excluded() | low).alias("excluded"), F.when(low, "low confidence").otherwise(old["reason"]).alias("reason"), F.when(low, "confidence").otherwise(old["stage"]).alias("stage"))
    return issues.withColumn("filter_metadata", meta)


def excluded() -> Column:
    return F.coalesce(F.col("filter_metadata.excluded"), F.lit(False))


def visible(issues: DataFrame) -> DataFrame:
    """F14."""
    return issues.where(~excluded())


def reason_histogram(issues: DataFrame) -> DataFrame:
    """AGG3."""
    return issues.where(excluded()).groupBy(F.col("filter_metadata.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stats(issues: DataFrame) -> DataFrame:
    """AGG4: one row: input, excluded, adjusted, passed."""
    return issues.agg(
        F.count(F.lit(1)).alias("input"),
        F.count_if(excluded()).alias("excluded"),
        F.count_if(excluded() & (F.col("confidence") < 1)).alias("adjusted"),
        F.count_if(~excluded()).alias("passed"),
    )
