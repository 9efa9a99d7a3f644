"""Reports and sinks: Markdown, grouped text, JSON, comments, metrics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from reviewlens.functions.severity import SEVERITIES
from reviewlens.functions.text import escape_cell
from reviewlens.operators.filters import visible


def _in_order(*fields: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def markdown(issues: DataFrame) -> DataFrame:
    """SNK4: a table of each review's issues: (``review_id``, ``report``); pipes escaped."""
    row = F.concat(F.lit("| "), "severity", F.lit(" | `"), escape_cell(F.col("file")), F.lit("` | "), F.coalesce(F.col("line"), F.lit(0)), F.lit(" | "), escape_cell(F.col("type")), F.lit(" | "), escape_cell(F.col("message")), F.lit(" |"))
    head = "| Severity | File | Line | Type | Message |\n|----------|------|------|------|--------|\n"
    rows = F.array_join(F.transform(_in_order(F.col("ord").alias("o"), row.alias("r")), lambda x: x["r"]), "\n")
    return issues.groupBy("review_id").agg(F.concat(F.lit(head), rows).alias("report"))


def grouped(issues: DataFrame) -> DataFrame:
    """SNK5, AGG7: a row for each review: its issues by severity, heaviest first, and whether it is blocked."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    text = F.concat(F.lit("["), "severity", F.lit("] "), F.coalesce("file", F.lit("-")), F.lit(":"), F.coalesce(F.col("line"), F.lit(0)), F.lit(" "), "message")
    rows = F.array_join(F.transform(_in_order(place.alias("p"), F.col("ord").alias("o"), text.alias("t")), lambda x: x["t"]), "\n")
    return issues.groupBy("review_id").agg(rows.alias("report"), F.when(F.bool_or(F.col("severity") == "CRITICAL"), "BLOCKED").otherwise("PASSED").alias("verdict"))


def json_documents(issues: DataFrame) -> DataFrame:
    """SNK6: a review's visible issues as one JSON document."""
    seen = visible(issues) if "filter_metadata" in issues.columns else issues
    listed = F.transform(_in_order(F.col("ord"), F.struct("severity", "file", "line", "type", "message").alias("i")), lambda x: x["i"])
    return seen.groupBy("review_id").agg(F.to_json(F.struct(listed.alias("issues"), F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False)).alias("has_critical_flag"))).alias("document"))


def post(comments: DataFrame, send_batch: Callable[[list[dict]], None], send_one: Callable[[dict], None], most: int = 50) -> DataFrame:
    """SNK3: comments go in batches, one by one where a batch fails; single failures are skipped.

    What became of each is returned: (``ord``, ``outcome``): ``batch``, ``single`` or ``skipped``. Comments are
    sent when the result is computed; write it down, as computing it again sends again.
    """

    def sent(send, what) -> bool:
        try:
            send(what)
        except Exception:  # noqa: BLE001  the boundary's errors decide the way, not the job
            return False
        return True

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), most):
                part = frame.iloc[a : a + most]
                rows = part.to_dict("records")
                whole = sent(send_batch, rows)
                yield pd.DataFrame({"ord": part.ord, "outcome": ["batch" if whole else "single" if sent(send_one, r) else "skipped" for r in rows]})

    return comments.mapInPandas(run, "ord long, outcome string")


def timed(action: Callable[[], object], clock: Callable[[], float]) -> tuple[object, float]:
    """SNK8: what an action gives, and the seconds that it took."""
    began = clock()
    return action(), clock() - began


def metered(issues: DataFrame, name: str = "issues") -> tuple[DataFrame, Observation]:
    """SNK8: counters that the next action fills, without a pass of their own."""
    seen = Observation(name)
    counters = [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]]
    return issues.observe(seen, *counters), seen
