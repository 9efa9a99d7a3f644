"""Budgets: chunks of diff entries, prompt batches, splitting of oversized entries."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import estimated_tokens

# Fixed values.
MOST_FILES, MOST_CHARS, MOST_TOKENS, SOFT_TOKENS, CHARS_A_TOKEN = 10, 60_000, 12_000, 9_000, 4
BATCH_TOKENS = 6_000


def next_bins(tokens: np.ndarray, budget: int, used: int = 0, number: int = 0) -> tuple[np.ndarray, int, int]:
    """PK6: the batch of each of some entries in order, going on from a batch that holds ``used``; then the last one's use and number.

    A batch ends where its sum passes the budget, found in the running sums; it holds an entry of any size if it has none yet.
    """
    total = np.concatenate([[0], np.cumsum(tokens)]) + used
    out, start, base = np.zeros(len(tokens), np.int64), 0, 0
    while start < len(tokens):
        over = max(start, int(np.searchsorted(total, base + budget, side="right")) - 1)
        end = over if total[over] > base else over + 1
        end = min(max(end, start), len(tokens))
        out[start:end] = number
        if end < len(tokens):
            number, base = number + 1, total[end]
        start = end
    return out, int(total[-1] - base), number


def next_fit(entries: DataFrame, budget: int = BATCH_TOKENS, key: str = "review_id") -> DataFrame:
    """PK6: prompt batches in order: a new batch where the next entry would overflow a batch that has any.

    A review's entries lie sorted in one partition and pass as a stream with one batch's use carried
    along, so a review of any length needs no more memory than a slice of it; contents never travel.
    """
    slim = entries.select(F.col(key).cast("string").alias(key), F.col("ord").cast("long").alias("ord"), "file_path", F.col("tokens").cast("long").alias("tokens"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used, number = None, 0, 0
        for frame in frames:
            bins = np.zeros(len(frame), np.int64)
            keys = frame[key].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if keys[a] != last:
                        last, used, number = keys[a], 0, 0
                    bins[a:b], used, number = next_bins(frame.tokens.to_numpy()[a:b], budget, used, number)
            yield frame.assign(bin=bins)

    return slim.repartition(key).sortWithinPartitions(key, "ord").mapInPandas(run, f"{key} string, ord long, file_path string, tokens long, bin long")


def weight(content: Column, tokens: Column) -> Column:
    """What entries are packed by, heaviest first."""
    return F.greatest(F.length(content), tokens * CHARS_A_TOKEN)


class OpenBins:
    """Bins that may take more, in order of (tokens, number), as a tree of two levels: blocks of some ``WIDTH`` bins, each with its fewest characters.

    Blocks without room are passed over whole, and only the block of a change is gone through.
    """

    WIDTH = 256

    def __init__(self):
        self.blocks: list[list[tuple[int, int, int, int]]] = []
        self.least: list[int] = []
        self.first: list[tuple[int, int]] = []

    def take(self, most_tokens: int, most_chars: int) -> tuple[int, int, int, int] | None:
        """Removes and returns the first bin of at most so many tokens and characters."""
        for k, block in enumerate(self.blocks):
            if self.first[k][0] > most_tokens:
                return None
            if self.least[k] > most_chars:
                continue
            for i, b in enumerate(block):
                if b[0] > most_tokens:
                    return None
                if b[2] <= most_chars:
                    del block[i]
                    self._note(k)
                    return b
        return None

    def add(self, b: tuple[int, int, int, int]) -> None:
        k = max(bisect_right(self.first, b[:2]) - 1, 0)
        if not self.blocks:
            self.blocks, self.least, self.first = [[]], [0], [b[:2]]
        insort(self.blocks[k], b)
        if len(self.blocks[k]) > 2 * self.WIDTH:
            rest = self.blocks[k][self.WIDTH :]
            del self.blocks[k][self.WIDTH :]
            self.blocks.insert(k + 1, rest)
            self.least.insert(k + 1, 0)
            self.first.insert(k + 1, rest[0][:2])
            self._note(k + 1)
        self._note(k)

    def _note(self, k: int) -> None:
        if self.blocks[k]:
            self.least[k], self.first[k] = min(b[2] for b in self.blocks[k]), self.blocks[k][0][:2]
        else:
            del self.blocks[k], self.least[k], self.first[k]


def pack_list(items: list[tuple[int, int]], most_files: int, most_chars: int, most_tokens: int, soft_tokens: int) -> list[int]:
    """PK2: the bin of each (chars, tokens), given heaviest first.

    An item goes to the least filled bin under the soft target that can hold it, else to the least
    filled one that can, else to a new one. Bins under the target are less filled than all others, so
    that is the first that can in order of (tokens, number); full ones leave the order.
    """
    bins, out, used = OpenBins(), [], 0
    for chars, tokens in items:
        found = bins.take(most_tokens - tokens, most_chars - chars)
        if found is None:
            found = (0, used, 0, 0)
            used += 1
        t, number, c, n = found
        out.append(number)
        if n + 1 < most_files:
            bins.add((t + tokens, number, c + chars, n + 1))
    return out


def chunks(entries: DataFrame, most_files: int = MOST_FILES, most_chars: int = MOST_CHARS, most_tokens: int = MOST_TOKENS, soft_tokens: int = SOFT_TOKENS, reviews: DataFrame | None = None) -> DataFrame:
    """PK1, PK2: chunk numbers of a review's entries; one chunk where all fits, by first fit of decreasing weight otherwise.

    Reviews (``review_id``) without any entry have one empty chunk, if ``reviews`` names them.

    Greedy packing is sequential within a review, so it runs once for each, over lengths only:
    contents stay behind and join again by (review, order).
    """
    slim = entries.select("review_id", "ord", "file_path", F.length("content").cast("long").alias("chars"), estimated_tokens(F.col("content"), F.col("token_count")).cast("long").alias("tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        if len(pdf) <= most_files and pdf.chars.sum() <= most_chars and pdf.tokens.sum() <= most_tokens:
            return pdf.assign(chunk=0)
        heavy = pdf[["chars"]].assign(t=pdf.tokens * CHARS_A_TOKEN).max(axis=1)
        pdf = pdf.iloc[(-heavy.to_numpy()).argsort(kind="stable")]
        return pdf.assign(chunk=pack_list(list(zip(pdf.chars.tolist(), pdf.tokens.tolist(), strict=True)), most_files, most_chars, most_tokens, soft_tokens))

    out = slim.groupBy("review_id").applyInPandas(run, "review_id string, ord long, file_path string, chars long, tokens long, chunk int")
    if reviews is None:
        return out
    empty = reviews.select("review_id").distinct().join(entries.select("review_id"), "review_id", "left_anti")
    return out.unionByName(empty.withColumn("chunk", F.lit(0)), allowMissingColumns=True)


_HEADER = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@(.*)")


def runs(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Cuts of a sequence into runs of at most ``room`` in all, one item at least in each: (begin, end)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    out, a = [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + room, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def split_hunk(hunk: str, most: int) -> list[str]:
    """PK4, W4: pieces of at most ``most`` characters, a line at least each, with headers that keep all line numbers.

    A piece's numbers follow from how many lines of the old and of the new file lie before its cut.
    """
    lines = hunk.splitlines(keepends=True)
    m = _HEADER.match(lines[0].rstrip("\n")) if lines else None
    if m is None or len(lines) == 1:
        return [hunk]
    body = lines[1:]
    before = {side: np.concatenate([[0], np.cumsum([x[0] not in other for x in body])]) for side, other in (("old", "+\\"), ("new", "-\\"))}

    def header(a: int, b: int) -> str:
        spans = [f"{sign}{int(m[g]) + before[side][a]},{before[side][b] - before[side][a]}" for sign, g, side in (("-", 1, "old"), ("+", 2, "new"))]
        return f"@@ {' '.join(spans)} @@{m[3]}\n"

    return [header(a, b) + "".join(body[a:b]) for a, b in runs([len(x) for x in body], most - len(lines[0]))]


def split_entry(content: str, tokens: int, most_chars: int = MOST_CHARS, most_tokens: int = MOST_TOKENS) -> list[str]:
    """PK3: an entry over the budget as groups of whole hunks under its header, hunks over it cut; whole without hunks."""
    if len(content) <= most_chars and tokens <= most_tokens:
        return [content]
    at = [m.start() for m in re.finditer(r"(?m)^@@ ", content)]
    if not at:
        return [content]
    head = content[: at[0]]
    room = max(1, min(most_chars, most_tokens * CHARS_A_TOKEN) - len(head))
    hunks = [content[a:b] for a, b in zip(at, [*at[1:], len(content)], strict=True)]
    pieces = [p for h in hunks for p in (split_hunk(h, room) if len(h) > room else (h,))]
    return [head + "".join(pieces[a:b]) for a, b in runs([len(p) for p in pieces], room)]


class SplitEntry:
    """PK3 as a table function: an entry's parts, in order, one row each."""

    def eval(self, content: str, tokens: int, most_chars: int, most_tokens: int):
        for part, text in enumerate(split_entry(content, tokens, most_chars, most_tokens)):
            yield part, text, max(1, len(text) // CHARS_A_TOKEN)


def split_oversized(entries: DataFrame, most_chars: int = MOST_CHARS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """PK3, PK4 over a table: entries within the budget pass; each of the others joins its parts, which a table function gives, laterally."""
    tokens = estimated_tokens(F.col("content"), F.col("token_count"))
    large = (F.length("content") > most_chars) | (tokens > most_tokens)
    small = entries.where(~large).select("review_id", "ord", F.lit(0).alias("part"), "file_path", "content", F.col("token_count").cast("int").alias("token_count"))
    parts = F.udtf(SplitEntry, returnType="part int, text string, parts_tokens int")
    over = entries.where(large).select("review_id", "ord", "file_path", "content", tokens.alias("tokens"))
    each = over.lateralJoin(parts(F.col("content").outer(), F.col("tokens").outer(), F.lit(most_chars), F.lit(most_tokens)))
    return small.unionByName(each.select("review_id", "ord", "part", "file_path", F.col("text").alias("content"), F.col("parts_tokens").alias("token_count")))


def compact(entries: DataFrame) -> DataFrame:
    """PK5: what a chunk says when its diff is too long: the paths of its files."""
    paths = F.transform(F.array_sort(F.collect_list(F.struct("ord", "file_path"))), lambda x: F.concat(F.lit("- "), x["file_path"]))
    head = "[DIFF_OMITTED_DUE_TO_SIZE]\nThe diff of this chunk is over the model's limit.\nChanged files:"
    return entries.groupBy("review_id", "chunk").agg(F.concat_ws("\n", F.lit(head), paths).alias("text"))
