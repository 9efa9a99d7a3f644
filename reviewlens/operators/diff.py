"""The diff relation: files, hunks, lines, and the lines of the new file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.functions.text import in_directory, matches_glob

#: Fixed values. The first needs no closing @@, the second does.
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))?"
STRICT_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def sections(diffs: DataFrame) -> DataFrame:
    """SRC1: ``diffs`` (``diff_id``, ``diff_text``) to a row for each file's section; one named ``full-diff`` where no header is found."""
    parts = F.filter(F.split("diff_text", r"(?m)(?=^diff --git)"), lambda x: F.trim(x) != "")
    out = diffs.select("diff_id", F.posexplode(parts).alias("ord", "content"))
    path = F.regexp_extract("content", r"^diff --git a/.*? b/(.*)", 1)
    return out.select("diff_id", "ord", F.when(path != "", path).otherwise("full-diff").alias("file_path"), "content")


def unified(path: Column, patch: Column) -> Column:
    """SRC4: the patch of one file as a unified diff."""
    return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), patch)


def pull_request(spec: Column) -> Column:
    """SRC3: ``owner/repo#n`` as a struct; null where it doesn't fit."""
    pattern = r"^([\w.-]+)/([\w.-]+)#(\d+)$"
    s = F.trim(spec)
    return F.when(s.rlike(pattern), F.struct(F.regexp_extract(s, pattern, 1).alias("owner"), F.regexp_extract(s, pattern, 2).alias("repo"), F.regexp_extract(s, pattern, 3).cast("int").alias("number")))


def to_lines(files: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """Lines with their place from 0, split at line feeds, a carriage return before one removed; trailing empty lines stay."""
    keys = keys or ("review_id", "file_path")
    return files.select(*keys, F.posexplode(F.split(content, r"\r?\n")).alias("pos", "line"))


#: Lines of a block; a diff's blocks are scanned side by side, so one huge diff fills all cores.
BLOCK = 1 << 16


def scanned(lines: DataFrame, diff: str, order: str, moves: Column, **marks: tuple[Column, Column]) -> DataFrame:
    """A scan of each diff's lines in two levels: adds ``_total``, the sum of ``moves`` over the lines before, and each of ``marks``.

    A mark is (where, value); its column is the last one at or before the line, as a struct of ``value`` and
    ``total`` (``_total`` there), null before any. Blocks of ``BLOCK`` places are scanned by themselves; their
    sums and last marks, one row for each block, are carried on along the diff and joined back.
    """
    here = Window.partitionBy(diff, "_block").orderBy(order)
    local = lines.withColumns({"_block": F.floor(F.col(order) / BLOCK), "_moves": moves})
    local = local.withColumn("_total", F.coalesce(F.sum("_moves").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mark = lambda value, total: F.struct(value.alias("value"), total.cast("long").alias("total"))
    local = local.withColumns({m: F.last(F.when(where, mark(value, F.col("_total"))), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)) for m, (where, value) in marks.items()})
    ends = local.groupBy(F.col(diff).alias("_d"), F.col("_block").alias("_b")).agg(F.sum("_moves").alias("_sum"), *[F.max_by(m, order).alias(f"{m}_end") for m in marks])
    earlier = Window.partitionBy("_d").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    whole = lambda c, base: F.when(c.isNotNull(), mark(c["value"], c["total"] + base))
    carry = carry.select("_d", "_b", "_base", *[F.last(whole(F.col(f"{m}_end"), F.col("_base")), ignorenulls=True).over(earlier).alias(f"{m}_end") for m in marks])
    out = local.join(carry, F.col(diff).eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_b")))
    out = out.withColumns({"_total": F.col("_total") + F.col("_base"), **{m: F.coalesce(whole(F.col(m), F.col("_base")), F.col(f"{m}_end")) for m in marks}})
    return out.drop("_block", "_moves", "_d", "_b", "_base", *[f"{m}_end" for m in marks])


def line_map(lines: DataFrame, diff: str = "review_id", order: str = "pos") -> DataFrame:
    """W1, W2, JN4: for every added line of a diff, its line in the new file: (``diff``, ``file_path``, ``diff_line``, ``file_line``).

    A segment starts at a hunk header and ends at a file header or a line that no hunk holds; within
    it, context, added and empty lines advance. File headers are tested first, so ``+++ `` and
    ``--- `` are never hunk lines.
    """
    line = F.col("line")
    header = line.startswith("+++ ") | line.startswith("--- ")
    start = ~header & line.startswith("@@")
    body = ~header & ~start & (line.startswith("+") | line.startswith("-") | line.startswith(" ") | line.startswith("\\") | (line == ""))
    path = F.regexp_replace(F.split(F.substr("line", F.lit(5)), "\t")[0], r"\s+$", "")
    path = F.regexp_replace(F.regexp_replace(path, "^a/", ""), "^b/", "")
    moves = (body & ~line.startswith("-") & ~line.startswith("\\")).cast("int")
    out = scanned(lines, diff, order, moves, _file=(line.startswith("+++ "), path), _seg=(~body, F.when(start, F.regexp_extract(line, HUNK, 1))))
    added = out.where(line.startswith("+") & ~line.startswith("+++ ") & F.col("_file").isNotNull() & (F.coalesce("_seg.value", F.lit("")) != ""))
    return added.select(diff, F.col("_file.value").alias("file_path"), (F.col(order) + 1).cast("int").alias("diff_line"), (F.col("_seg.value").cast("int") + F.col("_total") - F.col("_seg.total")).cast("int").alias("file_line"))


def changed_lines(lines: DataFrame, diff: str = "review_id", order: str = "pos", every: bool = False) -> DataFrame:
    """Added lines of the new file within their hunk's declared count; lines that start with ``++`` don't count.

    ``every``: they do, as the added text itself may start with a plus. A hunk then ends with its count or at the next
    file's ``diff --git``, so that file's ``+++ `` header isn't one of its lines.
    """
    line = F.col("line")
    plus = line.startswith("+") if every else line.startswith("+") & ~line.startswith("++")
    start = line.rlike(STRICT_HUNK)
    end = line.startswith("diff --git ") if every else F.lit(False)
    count = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(line, STRICT_HUNK, 2), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))
    moves = (~start & (line.startswith(" ") | plus)).cast("int")
    out = scanned(lines, diff, order, moves, _hunk=(start | end, F.when(start, F.struct(F.regexp_extract(line, STRICT_HUNK, 1).cast("int").alias("s"), count.alias("c")))))
    before = F.col("_total") - F.col("_hunk.total")
    added = out.where(F.col("_hunk.value").isNotNull() & plus & (before < F.col("_hunk.value.c")))
    return added.select(diff, (F.col("_hunk.value.s") + before).cast("int").alias("file_line")).distinct()


def hunk_headers(lines: DataFrame, diff: str = "review_id", order: str = "pos") -> DataFrame:
    """Every hunk header with its file: (``diff``, ``file_path``, ``header_line`` from 1, ``new_start``)."""
    path = F.regexp_replace(F.regexp_replace(F.substr("line", F.lit(5)), "^a/", ""), "^b/", "")
    out = scanned(lines, diff, order, F.lit(0), _file=(F.col("line").startswith("+++ "), path))
    out = out.where(F.col("line").startswith("@@ ")).withColumn("_n", F.regexp_extract("line", HUNK, 1)).where("_n != '' and _file is not null")
    return out.select(diff, F.col("_file.value").alias("file_path"), (F.col(order) + 1).cast("int").alias("header_line"), F.col("_n").cast("int").alias("new_start"))


def nearest_hunk(points: DataFrame, headers: DataFrame, diff: str = "review_id") -> DataFrame:
    """JN6: for each point (``diff``, ``file_path``, ``diff_line``) the start of the nearest hunk, the earlier on ties.

    The nearest header is the last at or before the point or the first after it, so instead of
    pairing points with all headers of a file, both are merged in order and two windows carry them, within blocks
    and then from block to block.
    """
    both = points.select(diff, "file_path", F.col("diff_line").alias("at"), F.lit(None).cast("int").alias("new_start"), F.lit(1).alias("kind")).unionByName(
        headers.select(diff, "file_path", F.col("header_line").alias("at"), "new_start", F.lit(0).alias("kind"))
    )
    head = F.when(F.col("kind") == 0, F.struct("at", "new_start"))
    key = [diff, "file_path"]
    both = both.withColumn("_block", F.floor(F.col("at") / BLOCK))
    w = Window.partitionBy(*key, "_block").orderBy("at", "kind")
    out = both.withColumns({"_b": F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first(head, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    # beyond a block: the last header of those before it, the first of those behind
    ends = both.groupBy(F.col(diff).alias("_d"), F.col("file_path").alias("_f"), F.col("_block").alias("_k")).agg(F.max_by(head, F.when(F.col("kind") == 0, F.col("at"))).alias("_last"), F.min_by(head, F.when(F.col("kind") == 0, F.col("at"))).alias("_first"))
    blocks = Window.partitionBy("_d", "_f").orderBy("_k")
    carry = ends.select("_d", "_f", "_k", F.last("_last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    out = out.where("kind = 1").join(carry, F.col(diff).eqNullSafe(F.col("_d")) & F.col("file_path").eqNullSafe(F.col("_f")) & (F.col("_block") == F.col("_k")))
    out = out.withColumns({"_b": F.coalesce("_b", "_earlier"), "_a": F.coalesce("_a", "_later")})
    before, after = F.col("at") - F.col("_b.at"), F.col("_a.at") - F.col("at")
    near = F.when(F.col("_b").isNull(), F.col("_a.new_start")).when(F.col("_a").isNull() | (before <= after), F.col("_b.new_start")).otherwise(F.col("_a.new_start"))
    return out.select(diff, "file_path", F.col("at").alias("diff_line"), near.alias("hunk_start"))


def overlapping(ranges: DataFrame, changed: DataFrame, diff: str = "review_id") -> DataFrame:
    """F16: ranges (``start_line``, ``end_line``) that hold a changed line; all, where a diff changes none.

    A sweep: a diff's changed lines and its ranges' starts lie in one order of lines, and the next changed line
    from a start on, carried back from behind, must not pass the range's end. No list of lines is made; the
    diffs that change nothing are the ranges' diffs without any changed line.
    """
    own = [F.col(c) for c in ranges.columns]
    # of equal lines the start comes first, so that the line itself is behind it
    starts = ranges.select(F.col(diff).alias("_d"), F.col("start_line").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(*own).alias("_row"))
    lines = changed.select(F.col(diff).alias("_d"), F.col("file_line").cast("long").alias("_at")).where("_at is not null").distinct().select("_d", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"))
    behind = Window.partitionBy("_d").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("_kind") == 1, F.col("_at"))
    swept = starts.unionByName(lines).withColumns({"_next": F.last(point, ignorenulls=True).over(behind), "_any": F.max("_kind").over(Window.partitionBy("_d"))})
    return swept.where((F.col("_kind") == 0) & ((F.col("_any") == 0) | (F.col("_next") <= F.col("_row.end_line")))).select("_row.*")


def relevant(full: Column, part: Column, share: float = 0.85) -> Column:
    """the reviewer's part of a diff, if it has any and is clearly shorter than the whole."""
    return F.when((F.length(part) > 0) & (F.length(part) < share * F.length(full)), part).otherwise(full)


def without_excluded(diffs: DataFrame, directories: list[str]) -> DataFrame:
    """each diff without the sections of excluded directories, the others in order."""
    parts = sections(diffs)
    keep = parts.where(~in_directory(F.col("file_path"), *directories)) if directories else parts
    return keep.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "").alias("diff_text"))


def accepted(entries: DataFrame, ignore: tuple[str, ...] = (), most_tokens: int = 4000, most_files: int = 20, count_first: bool = False) -> DataFrame:
    """F6-F8, SRC7: entries that aren't deleted, empty, ignored or too large, the first ``most_files`` of each review.

    ``count_first``: a file counts towards the limit before its tokens are looked at, as from a
    working copy; else only accepted files count, as from a pull request.
    """
    ok = F.col("content").isNotNull() & (F.col("content") != "") & ~F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in entries.columns else F.col("content").isNotNull() & (F.col("content") != "")
    if ignore:
        ok = ok & ~matches_glob(F.col("file_path"), *ignore)
    fits = F.col("token_count") <= most_tokens
    rows = entries.where(ok) if count_first else entries.where(ok & fits)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("review_id").orderBy("ord"))).where(F.col("nth") <= most_files)
    return (rows.where(fits) if count_first else rows).drop("nth")


def allowed(paths: Column, all_paths: Column) -> Column:
    """the given paths, trimmed, without blanks and repeats; all files where none is given."""
    given = F.array_distinct(F.filter(F.transform(paths, lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(all_paths)


def concatenated(entries: DataFrame) -> DataFrame:
    """AGG6: a file's contents in order, joined by line feeds."""
    return entries.groupBy("review_id", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n").alias("content"))


def within_budget(comments: DataFrame, marker: str, each: int = 200, most: int = 2000) -> DataFrame:
    """SRC6, W6: earlier comments with the marker, cut to ``each`` characters, up to the first that overflows ``most`` in all."""
    own = comments.where(F.contains("body", F.lit(marker))).withColumn("text", F.left("body", F.lit(each)))
    total = F.sum(F.length("text")).over(Window.partitionBy("review_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_total", total).where(F.col("_total") <= most).drop("_total")


def diff_context(entries: DataFrame, request: str) -> DataFrame:
    """GR8: ``summary`` gives the files of each review with their tokens; any other request the content of the file it names."""
    if request.strip() == "summary":
        line = F.concat(F.lit("- "), "file_path", F.lit(" ("), F.col("token_count"), F.lit(" tokens)"))
        return entries.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return entries.where(F.col("file_path") == request.strip()).select("review_id", F.col("content").alias("text"))
