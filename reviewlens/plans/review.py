"""Review pipelines: stages composed from a registry, and the deterministic flow from files to a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import filters, issues, rules
from reviewlens.sources.readers import parsed

Stage = Callable[[DataFrame], DataFrame]


def scan_stage(lines: DataFrame) -> DataFrame:
    found = rules.scan(lines)
    return found.withColumn("ord", F.xxhash64("review_id", "file", "line", "rule"))


#: §2.12: stages by name.
STAGES: dict[str, Stage] = {
    "static_rules": scan_stage,
    "false_positive_filter": filters.mark,
    "visible": filters.visible,
    "deduplicate": lambda df: issues.deduplicate(df, keys=("review_id",)) if "filter_metadata" not in df.columns else issues.deduplicate(df.drop("filter_metadata"), keys=("review_id",)),
    "report": issues.severity_report,
}
DEFAULT = ("static_rules", "false_positive_filter", "visible", "deduplicate", "report")


def compose(names: list[str] | tuple[str, ...] | None = None, registry: dict[str, Stage] | None = None) -> Stage:
    """A pipeline of the named stages; unknown names are skipped, an empty list is the default."""
    known = registry or STAGES
    chosen = [known[n] for n in names or () if n in known] or [known[n] for n in DEFAULT if n in known]

    def run(df: DataFrame) -> DataFrame:
        for stage in chosen:
            df = df.transform(stage)
        return df

    return run


def stages_of(text: str) -> list[str]:
    """§2.12: the stage names of a JSON or YAML text: ``{"pipeline": {"stages": [...]}}``, each a name or ``{"name": ..., "enabled": ...}``; none where it is broken."""
    try:
        listed = (parsed(text).get("pipeline") or {}).get("stages") or []
    except Exception:  # noqa: BLE001  a broken file means the default pipeline
        return []
    named = [{"name": s} if isinstance(s, str) else s for s in listed]
    return [s["name"] for s in named if isinstance(s, dict) and s.get("name") and s.get("enabled", True)]


def merged(*parts: DataFrame) -> DataFrame:
    """Static and reviewed issues, cached and fresh ones, or those of chunks, in one frame."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
