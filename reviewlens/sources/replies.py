"""Model replies to issues: fences and thinking stripped, JSON cut out of mixed text, tolerant parsing."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reviewlens.functions import severity as sev

ISSUE = "severity string, file string, line int, type string, message string, suggestion string"


def stripped(text: Column) -> Column:
    """Without thinking sections, and without a fence around everything."""
    out = F.trim(F.regexp_replace(text, r"(?s)<think(ing)?>.*?</think(ing)?>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def balanced(text: str, opens: str, closes: str) -> str | None:
    """SRC12: from the first ``opens`` to its partner, strings and escapes respected; None if it never closes."""
    start = text.find(opens)
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == opens) - (c == closes)
            if not depth:
                return text[start : i + 1]
    return None


def loose(text: str) -> str | None:
    """SRC13: the first fenced block, else the whole text if it is JSON, else the first braces that match, strings not respected."""
    m = re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.S)
    if m:
        return m[1]
    try:
        json.loads(text)
        return text.strip()
    except ValueError:
        depth, start = 0, -1
        for m in re.finditer(r"[{}]", text):
            if m[0] == "{":
                start = m.start() if not depth else start
                depth += 1
            else:
                depth -= 1
                if not depth and start >= 0:
                    return text[start : m.end()]
    return None


def _cut(text: str | None) -> str | None:
    """The object or array that comes first in the text, if it parses, else the other."""
    if not text:
        return None
    kinds = (("{", "}"), ("[", "]"))
    for opens, closes in kinds if text.lstrip()[:1] != "[" else kinds[::-1]:
        part = balanced(text, opens, closes)
        try:
            if part and isinstance(json.loads(part), dict | list):
                return part
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def cut_json(texts: pd.Series) -> pd.Series:
    return texts.map(_cut)


@F.pandas_udf(StringType())
def cut_json_loose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: loose(t) if t else None)


def parse(replies: DataFrame, variant: str = "strict") -> DataFrame:
    """SRC12, SRC13: (``reply_id``, ``issues``, ``has_critical``, ``raw``) of each reply (``reply_id``, ``text``).

    An object's ``has_critical`` counts if it is a boolean, else false; an array leaves it open.
    Text without usable JSON is ``raw``; blank text has no issues and is not. Severities are normal.
    """
    clean = stripped(F.coalesce("text", F.lit("")))
    out = replies.withColumn("_clean", clean).withColumn("_json", cut_json_loose("_clean") if variant == "loose" else cut_json("_clean"))
    wrapped = F.when(F.col("_json").startswith("["), F.concat(F.lit('{"issues":'), "_json", F.lit("}"))).otherwise(F.col("_json"))
    got = F.from_json(wrapped, f"issues array<struct<{', '.join(x.replace(' ', ':') for x in ISSUE.split(', '))}>>, has_critical boolean")
    out = out.withColumn("_got", got)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    issues = F.transform(F.coalesce("_got.issues", F.array().cast("array<struct<severity:string,file:string,line:int,type:string,message:string,suggestion:string>>")), lambda i: i.withField("severity", sev.normal(i["severity"])))
    critical = F.when(blank, False).when(F.col("_json").startswith("{"), F.coalesce("_got.has_critical", F.lit(False)))
    return out.select("reply_id", issues.alias("issues"), critical.alias("has_critical"), (F.col("_json").isNull() & ~blank).alias("is_raw"), F.when(F.col("_json").isNull() & ~blank, F.col("text")).alias("raw"))
