"""Sources: paged file listings, exported diffs, project trees, guarded reads, rules, settings, vectors, queues."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.errors import error_class
from reviewlens.functions.text import basename, matches_glob
from reviewlens.sources.shared import spread, written

PAGE = 100
#: Folders that a project scan leaves out, and the most bytes of a guarded read.
PRUNED = ("target", "build", ".git")
MOST_BYTES = 100_000


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """SRC2, SRC5: the pages that a fetcher left in a folder as ``1.json``, ``2.json`` and so on: (``page``, ``body``)."""
    page = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int")
    return spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(page.alias("page"), F.col("value").alias("body"))


def pull_request_files(pages: DataFrame, max_files: int) -> DataFrame:
    """SRC2, SRC5: a pull request's files: (``page``, ``ord`` from 0, ``file_path``, ``status``, ``patch``), at most ``max_files``.

    A page of fewer than ``PAGE`` files is the last one, as is a missing or a broken one; what lies after it doesn't count. Which
    that is is one aggregate over the pages' numbers, so every page is read once or twice and by any task.
    """
    files = F.from_json("body", "array<struct<filename:string,status:string,patch:string>>")
    read = pages.where(F.col("page") <= -(-max_files // PAGE)).select("page", files.alias("files"))
    full = read.where(F.size("files") >= PAGE).agg(F.array_sort(F.collect_set("page")).alias("p"))
    # pages 1, 2, ... without a gap are full; as many numbers as pages
    upto = full.select(F.size(F.filter("p", lambda x, i: x == i + 1)).alias("n")).first()["n"]
    each = read.where(F.col("page") <= upto + 1).select("page", F.posexplode("files").alias("k", "f"))
    out = each.select("page", ((F.col("page") - 1) * PAGE + F.col("k")).cast("long").alias("ord"), F.col("f.filename").alias("file_path"), "f.status", "f.patch")
    return out.where(F.col("ord") < max_files)


def exported_diffs(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: diffs exported from a working copy or between refs, one file each: (``diff_id``, ``diff_text``)."""
    return spark.read.text(path, wholetext=True).select(basename(F.input_file_name()).alias("diff_id"), F.col("value").alias("diff_text"))


def project_files(spark: SparkSession, root: str, extension: str = "java") -> DataFrame:
    """SRC8: the source files under a folder: (``file_path``, ``content``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(root)
    path = F.substring_index("path", root.rstrip("/") + "/", -1)
    return project_sources(files.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("content")), extension)


def project_sources(files: DataFrame, extension: str = "java") -> DataFrame:
    """SRC8: of ``files`` those of a project's sources, without build folders and generated files."""
    out = files.where(F.col("file_path").endswith("." + extension))
    for d in PRUNED:
        out = out.where(~F.col("file_path").startswith(d + "/") & ~F.contains("file_path", F.lit(f"/{d}/")))
    return out.where(~F.contains(F.left("content", F.lit(500)), F.lit("@Generated")))


def guarded(files: DataFrame, allowed: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """SRC9: of ``files`` (``file_path``, ``content``) those on the list, inside the root, and not too large."""
    inside = ~F.col("file_path").rlike(r"(^|/)\.\.(/|$)") & ~F.col("file_path").startswith("/")
    return files.where(inside & (F.octet_length("content") <= most)).join(allowed.select("file_path").distinct(), "file_path", "left_semi")


def load_rules(path: str | None, fallback: list[dict] | None = None) -> list[dict]:
    """SRC10: exclusion rules from a JSON or YAML file; the fallback where it is missing or can't be read."""
    try:
        with open(path or "", encoding="utf-8") as f:
            return rules_of(f.read(), fallback)
    except OSError:
        return fallback or []


def parsed(text: str) -> dict:
    """A JSON or YAML document as a mapping; YAML only where its package is installed."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    return found if isinstance(found, dict) else {}


def rules_of(text: str, fallback: list[dict] | None = None) -> list[dict]:
    """SRC10: the exclusion rules of a JSON or YAML text; the fallback where it has none or is broken."""
    try:
        return parsed(text).get("exclusion_rules", fallback or [])
    except Exception:  # noqa: BLE001  a broken rule file must not stop a review
        return fallback or []


@dataclass(frozen=True)
class Settings:
    """SRC11: the settings of a review, with defaults."""

    provider: str = "claude"
    model: str = "default"
    max_files: int = 20
    max_tokens_per_file: int = 4000
    ignore: tuple[str, ...] = ()
    rules: tuple[str, ...] = ("security", "logic", "quality")
    language: str = "en"
    pipeline: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.max_files < 1 or self.max_tokens_per_file < 1:
            raise ValueError("max_files and max_tokens_per_file must be positive")


def _merged(base: dict, over: dict) -> dict:
    return base | {k: _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items() if v is not None}


def load_settings(project: dict | None, home: dict | None, defaults: dict | None = None) -> Settings:
    """The defaults, overlaid by the project's settings or, only where there are none, the home folder's; nested keys one by one."""
    given = _merged(defaults or {}, project if project is not None else home or {})
    known = Settings.__dataclass_fields__
    plain = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known and k != "extra"}
    return Settings(**plain, extra=_merged({}, {k: v for k, v in given.items() if k not in known}))


class VectorTable:
    """SRC14: vectors as a Parquet table: add, count, search, delete. An absent table is an empty one.

    Adding and deleting append; a vector's row of the highest version counts, so an added id replaces
    its old vector. ``compact`` leaves those rows alone.
    """

    SCHEMA = "chunk_id string, embedding array<float>, version long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _append(self, rows: DataFrame) -> None:
        version = (self._all().agg(F.max("version")).first()[0] or 0) + 1
        rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self._all()
        if rows.agg(F.max("version")).first()[0] in (None, 1):
            return rows.where("embedding is not null").select("chunk_id", "embedding")
        last = rows.groupBy("chunk_id").agg(F.max_by("embedding", "version").alias("embedding"))
        return last.where("embedding is not null")

    def add(self, vectors: DataFrame) -> None:
        """Of several vectors of one id in a call, one is kept."""
        self._append(vectors.groupBy("chunk_id").agg(F.max("embedding").cast("array<float>").alias("embedding")))

    def delete(self, ids: DataFrame) -> None:
        self._append(ids.select("chunk_id", F.lit(None).cast("array<float>").alias("embedding")).distinct())

    def compact(self) -> None:
        rows = written(self.read().withColumn("version", F.lit(1).cast("long")), "vectors")
        rows.write.mode("overwrite").parquet(self.path)

    def count(self) -> int:
        return self.read().count()

    def search(self, query: list[float], k: int) -> DataFrame:
        from reviewlens.operators.retrieval import search_vectors

        return search_vectors(self.read(), query, k, "chunk_id")

    def clear(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)


def review(chunks: DataFrame, reviewer_fn: Callable[[str, str], str], reviewers: tuple[str, ...] = ("security", "logic", "quality"), parallel: int | None = None) -> DataFrame:
    """SRC17, ST11: an injected model call for every chunk and reviewer: (``review_id``, ``chunk``, ``reviewer``, ``ord``, ``reply``, ``error``).

    Chunks are reviewed where they lie, as many tasks at a time as there are splits and cores, and no text is
    shuffled. ``parallel``: at most so many at a time, 1 where calls share a tool session; each such task then
    reads its share of all chunks. A failure is its row's error, and ``kind`` its class. Replies keep the chunks'
    order by ``ord``.
    """
    each = chunks.select("review_id", "chunk", "text", F.concat_ws("/", "review_id", F.lpad(F.col("chunk").cast("string"), 6, "0"), F.lit("")).alias("ord"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                for name in reviewers:
                    try:
                        out.append((r.review_id, r.chunk, name, f"{r.ord}{name}", reviewer_fn(name, r.text), None))
                    except Exception as e:  # noqa: BLE001  what the boundary raises is data here
                        out.append((r.review_id, r.chunk, name, f"{r.ord}{name}", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["review_id", "chunk", "reviewer", "ord", "reply", "error"])

    each = spread(each) if parallel is None else each.coalesce(parallel)
    out = each.mapInPandas(run, "review_id string, chunk int, reviewer string, ord string, reply string, error string")
    return out.withColumn("kind", F.when(F.col("error").isNotNull(), error_class(F.col("error"))))


def with_retry(call: Callable, classify: Callable[[Exception], str], sleep: Callable[[float], None], retries: int = 3, base: float = 2.0, most: float = 30.0, jitter: Callable[[], float] = lambda: 1.0):
    """§2.12: a call that is tried again: never after a timeout, ever later after a rate limit or server error, else after a fixed delay."""

    def run(*args):
        for attempt in range(retries + 1):
            try:
                return call(*args)
            except Exception as e:
                kind = classify(e)
                if kind == "timeout" or attempt >= retries:
                    raise
                sleep(jitter() * (min(base * 2**attempt, most) if kind in ("rate_limit", "server") else base))
        raise AssertionError("unreachable")

    return run


def poll(fetch: Callable[[], dict], done: Callable[[dict], bool], clock: Callable[[], float], sleep: Callable[[float], None], timeout: float, every: float) -> dict:
    """ST10: fetch until done; TimeoutError after ``timeout`` seconds."""
    end = clock() + timeout
    while True:
        state = fetch()
        if done(state):
            return state
        if clock() >= end:
            raise TimeoutError(f"not done after {timeout} s")
        sleep(every)


def ignored(paths: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """F6."""
    return paths.where(~matches_glob(F.col("file_path"), *patterns)) if patterns else paths
