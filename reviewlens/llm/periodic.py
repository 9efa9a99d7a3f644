"""Runs of words (maximal repetitions), by the runs theorem.

The longest Lyndon word that starts at a place ends before the next smaller suffix. Every run of period p
holds a word of length p that is such a longest Lyndon word under an order of the words or under its
reverse. So each place proposes one root an order; the root goes on to the right and to the left as far
as the suffixes one period apart agree: longest common extensions, minima of the LCP array over a
range, by a sparse table. Suffix arrays come from doubled ranks over all texts of a batch at once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from reviewlens.llm.common import in_python, text_buffers, word_spans

#: Bytes of text whose suffixes are sorted together; they bound memory, not results. A longer text is sorted by itself.
SLICE_BYTES = 1 << 20


def word_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = raw[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])] if len(start) else raw[:0]
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Suffixes:
    """The suffixes of sequences that lie one after the other in ``ids``; ``of`` is the number of each place's sequence, ``stop`` its end.

    ``rank``: each suffix's place among all, those of a later sequence first, a prefix before what it
    begins. ``extension(i, j)``: how far two suffixes of one sequence agree.
    """

    def __init__(self, ids: np.ndarray, of: np.ndarray, stop: np.ndarray, lcp: bool = True):
        n = self.n = len(ids)
        self.levels: list[np.ndarray] = []
        if not n:
            return
        # by sequence, the last first, then by the first word
        key = (of[-1] - of) * (int(ids.max()) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank, left = self._named(order, key[order], np.zeros(n, np.int64), np.arange(n))
        width = 1
        self.levels.append(rank.astype(np.int32))
        while len(left):
            ahead = left + width
            inside = ahead < stop[left]
            second = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
            # within a group of equal ranks only the second halves matter
            by = np.lexsort((second, rank[left]))
            left = left[by]
            first, second = rank[left], second[by]
            new = np.ones(len(left), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            group = np.ones(len(left), bool)
            group[1:] = first[1:] != first[:-1]
            at = np.arange(len(left))
            # a name is the number of the first suffix of its kind in the whole order
            name = first + at - np.maximum.accumulate(np.where(group, at, 0))
            name = name[np.maximum.accumulate(np.where(new, at, 0))]
            rank = rank.copy()
            rank[left] = name
            width *= 2
            self.levels.append(rank.astype(np.int32))
            alone = new & np.append(new[1:], True)
            left = left[~alone]
        self.rank, self.stop, self.of = rank, stop, of
        if lcp:
            self._lcp()
        else:
            self.levels = []

    @staticmethod
    def _named(order, key, rank, at):
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        alone = new & np.append(new[1:], True)
        return rank, order[~alone]

    def _lcp(self) -> None:
        """LCP of neighbours in the order, from the names of ever shorter blocks; then its sparse table."""
        n = self.n
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        lcp = np.zeros(n, np.int32)
        # neighbours that share a first word
        at = np.flatnonzero(self.levels[0][order[1:]] == self.levels[0][order[:-1]]) + 1
        a, b = order[at - 1], order[at]
        far = np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + far, b + far
            ok = (x < self.stop[a]) & (y < self.stop[b])
            same = np.flatnonzero(ok)
            same = same[self.levels[k][x[same]] == self.levels[k][y[same]]]
            far[same] += 1 << k
        # blocks at a text's end are named by what they hold, so equal names are equal, full blocks
        lcp[at] = far
        self.levels = []
        self.table = [lcp]
        longest = int((self.stop - np.arange(n)).max())
        while 2 << (len(self.table) - 1) <= longest:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common prefix of the suffixes at ``i`` and at ``j`` != ``i``, of one sequence."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def next_smaller(self) -> np.ndarray:
        """For each place the first one behind it whose suffix is smaller, at the latest its sequence's end.

        Places look ahead in blocks that double while all in them is larger, and then halve; a later
        sequence's ranks are smaller, so that no search leaves its own.
        """
        n, rank = self.n, self.rank
        levels = [rank]
        at, todo = np.arange(1, n + 1), np.arange(n)
        found: list[tuple[int, np.ndarray]] = []
        k = 0
        while len(todo):
            size = len(levels[k])
            inside = at[todo] < size
            # past the table's end lies the last sequence's end, which is smaller than all
            larger = np.zeros(len(todo), bool)
            larger[inside] = levels[k][at[todo[inside]]] > rank[todo[inside]]
            found.append((k, todo[~larger]))
            todo = todo[larger]
            at[todo] += 1 << k
            if len(todo):
                half = 1 << k
                levels.append(np.minimum(levels[k][:-half], levels[k][half:]) if size > half else levels[k][:0])
                k += 1
        for top, some in found:
            for k in range(top - 1, -1, -1):
                inside = at[some] < len(levels[k])
                larger = np.zeros(len(some), bool)
                larger[inside] = levels[k][at[some[inside]]] > rank[some[inside]]
                at[some[larger]] += 1 << k
        return np.minimum(at, self.stop)


def runs(ids: np.ndarray, first: np.ndarray, least: int = 2, times: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the sequences ``ids[first[k]:first[k + 1]]`` of at least ``least`` words and ``times`` periods: sequence, start in it, length, period; by sequence, start, period."""
    counts = np.diff(first)
    of, stop = np.repeat(np.arange(len(counts)), counts), np.repeat(first[1:], counts)
    proposals = []
    plain = Suffixes(ids, of, stop)
    if plain.n:
        top = int(ids.max())
        for suffixes in (plain, Suffixes(top - ids, of, stop, lcp=False)):
            period = suffixes.next_smaller() - np.arange(plain.n)
            i = np.flatnonzero(np.arange(plain.n) + period < stop)
            right = plain.extension(i, i + period[i])
            # the leftmost root of a run of enough periods goes on for all of them but two
            some = right > (times - 2) * period[i]
            proposals.append(np.stack([i[some], period[i[some]], right[some]]))
    i, period, right = np.concatenate(proposals, axis=1) if proposals else np.zeros((3, 0), np.int64)
    if not len(i):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # roots of one run end together; the leftmost of a text is enough, but all are tried from both ends
    mine = np.unique(of[i])
    place = np.full(len(counts), -1)
    place[mine] = np.arange(len(mine))
    size = counts[mine]
    begin = np.concatenate([[0], np.cumsum(size)])
    # the same words backwards, of the sequences with proposals alone
    at = np.repeat(first[mine + 1] - 1 + begin[:-1], size) - np.arange(begin[-1])
    back = Suffixes(ids[at], np.repeat(np.arange(len(mine)), size), np.repeat(begin[1:], size))
    k = place[of[i]]
    # the word before place x of sequence k lies at begin[k] + (its end - x) backwards
    x = begin[k] + first[mine[k] + 1] - i
    left, inside = np.zeros(len(i), np.int64), i > first[of[i]]
    left[inside] = back.extension(x[inside], x[inside] - period[inside])
    start, length = i - left, left + period + right
    ok = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([of[i[ok]], start[ok] - first[of[i[ok]]], period[ok], length[ok]]), axis=1)
    return found[0], found[1], found[3], found[2]


def repeated_tail(key: int | None, n: int) -> tuple[int, int] | None:
    """Fixed rule of the query: from which word on, and with which period, a document's words repeat; a tenth of the keys."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


OUT = [("n_runs", LongType()), ("start", LongType()), ("length", LongType()), ("period", LongType()), ("exponent_milli", LongType()), ("runs_sha256", StringType()), ("collapsed_sha256", StringType()), ("runs", StringType()), ("collapsed", StringType())]


def collapse(df: DataFrame, text: str = "text", key: str | None = None, least: int = 6, times: int = 4, tail=None, outputs: bool = True) -> DataFrame:
    """The runs of each text's words, and the text without their repetitions.

    A run is a stretch of words that are equal one period apart, of at least ``least`` words and
    ``times`` periods, that no neighbour extends; ``period`` is its smallest. Adds ``n_runs``; for the
    longest (ties: the first, then the shortest period) ``start``, ``length``, ``period`` and
    ``exponent_milli``, null where there is none; SHA-256 of ``runs`` (``start,length,period`` and a line feed
    each) and of ``collapsed`` (the words outside the repetitions after each run's first period, joined by one
    space); with ``outputs`` these two themselves. ``tail(key, n)`` gives a text of ``n`` words a place and a
    period from which on its words repeat before they are judged, or None.

    Null texts have no words, no runs and an empty ``collapsed``; every row is judged by itself, so
    repeated rows repeat and an empty table stays empty. Columns of the added names are replaced, whatever
    their case; others stay. A text is sorted whole, in about 150 bytes a word of a worker's memory.
    """
    out = [o for o in OUT if outputs or o[0] not in ("runs", "collapsed")]
    taken = {name for name, _ in out}
    kept = [c for c in df.columns if c.lower() not in taken]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text"), (F.col(key) if key else F.lit(None)).cast("long").alias("_key"))

    def run(batches):
        for batch in batches:
            at = text_buffers(batch.column(len(kept)))[1]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1)
                part = batch.slice(a, b - a)
                a = b
                values = _collapsed(part.column(len(kept)), part.column(len(kept) + 1).to_pylist(), least, times, tail, outputs)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *values], [*kept, *[name for name, _ in out]])

    schema = StructType([*rows.schema.fields[: len(kept)], *[StructField(name, kind) for name, kind in out]])
    return rows.transform(in_python, run, schema)


def _collapsed(texts: pa.Array, keys: list, least: int, times: int, tail, outputs: bool) -> list[pa.Array]:
    raw, at = text_buffers(texts)
    start, end, first = word_spans(raw, at)
    if tail:
        word = np.arange(len(start))
        for k, key in enumerate(keys):
            n = int(first[k + 1] - first[k])
            rule = tail(key, n)
            if rule:
                i = np.arange(rule[0], n)
                word[first[k] + i] = first[k] + rule[0] + (i - rule[0]) % rule[1]
        start, end = start[word], end[word]
    ids = word_ids(raw, start, end)
    of, where, length, period = runs(ids, first, least, times)
    # repetitions: from each run's second period to its end
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, first[of] + where + period, 1)
    np.add.at(edge, first[of] + where + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    size = (end - start + 1)[keep]
    offsets = np.concatenate([[0], np.cumsum(size)])
    spot = np.repeat(start[keep] - offsets[:-1], size) + np.arange(offsets[-1])
    spaced = np.append(raw, np.uint8(32))
    # a word and a space each; the character behind a word is white space or another text's, so it is set
    flat = spaced[np.minimum(spot, len(raw))]
    flat[offsets[1:] - 1] = 32
    data = flat.tobytes()
    words_before = np.concatenate([[0], np.cumsum(keep)])
    cut = offsets[words_before[first]].tolist()
    bounds = np.searchsorted(of, np.arange(len(keys) + 1)).tolist()
    rows = []
    for k in range(len(keys)):
        a, b = bounds[k], bounds[k + 1]
        mine = list(zip(where[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        best = max(mine, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in mine)
        text = data[cut[k] : max(cut[k + 1] - 1, cut[k])]
        rows.append((len(mine), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), listed, text.decode()))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 5 + [pa.string()] * (4 if outputs else 2)
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
