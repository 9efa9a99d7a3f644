"""Best-fit packing of token sequences by the linear grouping scheme."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import _LOWER, in_python, keep, ranked, text_buffers, word_hashes, word_spans

# --- tokens ------------------------------------------------------------------

#: Bytes of text that are tokenized at once, and words whose ids a task remembers; they bound memory, not results.
SLICE_BYTES = 2 << 20
REMEMBERED = 400_000


def for_worker(name: str, key, load):
    """What ``load`` makes, kept by the process for its later tasks with an equal ``key``; another key replaces it.

    A tokenizer that is loaded anew in each task leaves some megabytes behind each time, so that a worker would grow
    with its number of tasks. Functions come to workers by value, so a module of the process holds it.
    """
    import sys
    import types

    place = vars(sys.modules.setdefault("_reviewlens_worker", types.ModuleType("_reviewlens_worker")))
    if name not in place or place[name][0] != key:
        place.pop(name, None)  # its memory goes before more is taken
        place[name] = key, load()
    return place[name][1]


class WordTokens:
    """Token ids of texts by a tokenizer that lower-cases and drops white space: those of its words.

    Distinct words are tokenized once, joined into long strings with the end token's string between
    them. A full stop or comma after an ASCII letter at a word's end is a token of its own, so the
    word is looked up without it. Words of nothing but small Latin letters need no normalizing and
    are one piece to the tokenizer, which spares them its slower steps.
    """

    def __init__(self, spec: str, between: str = "<|endoftext|>"):
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        def load():
            full = Tokenizer.from_str(spec)
            quick = Tokenizer(full.model)  # one model in memory
            quick.add_special_tokens([between])
            quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            return full, quick

        self.between = between
        self.full, self.quick = for_worker("tokenizers", (spec, between), load)
        self.latin = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
        self.stops = {c: self.full.encode(chr(c), add_special_tokens=False).ids for c in b".,"}
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _joined(self, tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words``, one after the other, and how many each has."""
        between, flat, sizes = f" {self.between} ", [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 10_000):
            runs = [words[i : i + 500] for i in range(a, min(a + 10_000, len(words)), 500)]
            texts = [between.join([*(b"\n".join(run).decode("utf-8", "replace").split("\n")), ""]) for run in runs]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            mark = tokenizer.token_to_id(self.between)
            sizes.append(np.diff(np.flatnonzero(ids == mark), prepend=-1) - 1)
            flat.append(ids[ids != mark])
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, w in enumerate(words):
            kinds[0 if self.latin(w) else 2 if b"<|" in w else 1].append(i)
        parts = [self._joined(t, [words[i] for i in k]) for t, k in zip((self.quick, self.full), kinds, strict=False)]
        odd = [np.array(self.full.encode(words[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for i in kinds[2]]
        order = np.array([*kinds[0], *kinds[1], *kinds[2]], np.int64)
        sizes = np.concatenate([parts[0][1], parts[1][1], np.array([len(x) for x in odd], np.int64)])
        known = np.concatenate([self.known, hashes[order]])
        place = np.concatenate([self.place, len(self.first) - 1 + np.arange(len(order))])
        by = np.argsort(known, kind="stable")
        self.known, self.place = known[by], place[by]
        self.flat = np.concatenate([self.flat, parts[0][0], parts[1][0], *odd])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, one after the other, and each text's first (n + 1)."""
        raw = _LOWER[raw]
        start, end, first = word_spans(raw, at)
        tail = np.zeros(len(start), np.uint8)
        if len(raw):
            before = raw[np.maximum(end - 2, 0)]
            stop = (end - start > 1) & ((raw[end - 1] == 46) | (raw[end - 1] == 44)) & (before >= 97) & (before <= 122)
            tail[stop] = raw[end[stop] - 1]
            end = end - stop
        hashes = word_hashes(raw, start, end)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = spot < len(self.known)
        fresh[inside] = self.known[spot[inside]] != distinct[inside]
        if fresh.any():
            data = raw.tobytes()
            self._learn(distinct[fresh], [data[a:b] for a, b in zip(start[where[fresh]].tolist(), end[where[fresh]].tolist(), strict=True)])
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        entry = self.place[np.searchsorted(self.known, distinct)][inverse]
        size = self.first[entry + 1] - self.first[entry]
        more = np.zeros(len(size), np.int64)
        for c, ids in self.stops.items():
            more[tail == c] = len(ids)
        total = np.concatenate([[0], np.cumsum(size + more)])
        out = np.zeros(total[-1], np.uint32)
        within = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(within[-1]) - np.repeat(within[:-1], size)
        out[step + np.repeat(total[:-1], size)] = self.flat[step + np.repeat(self.first[entry], size)]
        for c, ids in self.stops.items():
            for k, x in enumerate(ids):
                out[(total[:-1] + size)[tail == c] + k] = x
        return out, total[first]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most`` bytes of text, or of one row."""
    at = text_buffers(batch.column(batch.schema.get_field_index(column)))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def id_bytes(spec: str, end: int) -> int:
    """Bytes that hold any id of a tokenizer: 2, or 4 if there are ids past 65 535."""
    from tokenizers import Tokenizer

    return 2 if max(end, *Tokenizer.from_str(spec).get_vocab().values()) < 1 << 16 else 4


def widened(df: DataFrame) -> DataFrame:
    """``df`` with its ``ids`` of 2 bytes as ids of 4; on disk and on the way they take half."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            ids = [np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in batch.column(k)]
            yield batch.set_column(k, "ids", pa.array(ids, pa.binary()))

    return df.transform(in_python, run, df.schema)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, key: str, text: str, end: int = 1) -> DataFrame:
    """A row for each piece of each document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids`` (of ``id_bytes`` each, little-endian)."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    width = id_bytes(spec, end)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        tokens = WordTokens(spec)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                ids, first = tokens(*text_buffers(part.column(1)))
                keys, out = part.column(0), []
                for i in range(part.num_rows):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end)).astype("<u4")
                    out += [(i, k, s, len(x), zlib.crc32(x), x.astype(f"<u{width}").tobytes()) for k, s in enumerate(range(0, len(own), capacity)) for x in [own[s : s + capacity]]]
                rows = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[0])), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]], pa.array(rows[5], pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.transform(in_python, run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


# --- the plan: from counts of lengths to places --------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int, most: int = 400) -> list[tuple[list[int], int]]:
    """Patterns (how many of each size) and how often to use each, whole numbers, short of the demand only by the rounding.

    The linear program over all patterns is solved by column generation: the simplex method over one
    basis, each new pattern found as the unbounded knapsack of the highest dual value. Stopped after
    ``most`` patterns the last basis still meets the demand, with more bins than need be.
    """
    k, each = len(sizes), np.array(sizes)
    basis = [[capacity // s if i == j else 0 for j in range(k)] for i, s in enumerate(sizes)]
    need = np.array(demand, float)
    for _ in range(most):
        matrix = np.array(basis, float).T
        dual = np.linalg.solve(matrix.T, np.ones(k))
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        low = min(sizes)
        for c in range(low, capacity + 1):
            worth = np.where(each <= c, value[c - each] + dual, 0)
            i = int(worth.argmax())
            value[c], choice[c] = (worth[i], i) if worth[i] > value[c - 1] + 1e-12 else (value[c - 1], -1)
        if value[capacity] <= 1 + 1e-7:
            break
        pattern, c = [0] * k, capacity
        while c >= low:
            if choice[c] < 0:
                c -= 1
            else:
                pattern[choice[c]] += 1
                c -= sizes[choice[c]]
        direction, level = np.linalg.solve(matrix, np.array(pattern, float)), np.linalg.solve(matrix, need)
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[leave] = pattern
    level = np.linalg.solve(np.array(basis, float).T, need)
    return [(p, int(x + 1e-9)) for p, x in zip(basis, level, strict=True) if x >= 1 - 1e-9]


Place = tuple[int, int, int, int, int, int]


def bins_of(places: list[Place]) -> int:
    return max((first + -(-(end - rank) // each) for _, rank, end, first, each, _ in places), default=0)


#: (groups, the share of a bin that a configuration may leave empty), tried in this order.
SCHEMES = ((20, 1.0), (20, 0.005), (0, 1.0), (60, 1.0), (60, 0.005))


def plan(counts: dict[int, int], capacity: int) -> list[Place]:
    """The grouped plan of the fewest bins among ``SCHEMES``; one within 1/500 of the least possible ends the search.

    Rounding up costs about one part in the groups of the bins, which more groups lower; where a
    configuration of rounded lengths would leave much of its bins empty, its items go best-fit with
    the small ones instead, and without any group all do, so best fit alone is never better.
    """
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best: list[Place] | None = None
    solved: dict = {}
    for groups, waste in SCHEMES:
        found = grouped_plan(counts, capacity, groups, waste=waste, solved=solved)
        if best is None or bins_of(found) < bins_of(best):
            best = found
        if bins_of(best) <= least + least // 500:
            break
    return best or []


def grouped_plan(counts: dict[int, int], capacity: int, groups: int = 20, small: int = 8, waste: float = 1.0, solved: dict | None = None) -> list[Place]:
    """Places for ``counts[length]`` items of each length: (length, first rank, end rank, first bin, items a bin, offset).

    Item ``r`` of a length, first rank <= r < end rank, goes to bin ``first bin + (r - first rank) // items``
    at ``offset + (r - first rank) % items * length``. Lengths above ``capacity / small`` fall into
    groups of equal cardinality, each rounded up to its largest; the few sizes are packed by optimal
    configurations that leave at most ``waste`` of a bin empty, actual items take the places, longest first, and all others go best-fit by
    decreasing length; without ``groups`` all items do. Work and result depend on the number of
    different lengths, never of items.
    """
    places: list[Place] = []
    free: dict[int, list[tuple[int, int, int]]] = {}  # room left: runs of alike bins (first bin, bins, offset)
    rooms: list[int] = []
    bins = 0

    def release(room: int, first: int, n: int, offset: int) -> None:
        if n and room:
            if room not in free:
                insort(rooms, room)
                free[room] = []
            free[room].append((first, n, offset))

    large = sorted((x for x in counts if capacity // small < x < capacity), reverse=True) if groups else []
    total = sum(counts[x] for x in large)
    if total:
        queues: list[list[list[int]]] = []  # of each group: length, next rank, items left
        per, room = -(-total // groups), 0
        for x in large:
            if 2 * counts[x] >= per:  # frequent enough to be a group, which no rounding touches
                queues.append([[x, 0, counts[x]]])
                room = 0
                continue
            left, rank = counts[x], 0
            while left:
                if not room:
                    queues.append([])
                    room = per
                n = min(left, room)
                queues[-1].append([x, rank, n])
                left, rank, room = left - n, rank + n, room - n
        sizes = [q[0][0] for q in queues]
        solved = {} if solved is None else solved  # configurations by groups, which several schemes share
        if groups not in solved:
            solved[groups] = configurations(sizes, [sum(r[2] for r in q) for q in queues], capacity)
        for pattern, times in solved[groups]:
            if capacity - sum(n * x for n, x in zip(pattern, sizes, strict=True)) > waste * capacity:
                continue
            slots = []  # for each slot: its runs of (length, rank, items)
            for g, many in enumerate(pattern):
                for _ in range(many):
                    runs, left = [], times
                    while left and queues[g]:
                        run = queues[g][0]
                        n = min(left, run[2])
                        runs.append((run[0], run[1], n))
                        run[1], run[2], left = run[1] + n, run[2] - n, left - n
                        if not run[2]:
                            queues[g].pop(0)
                    slots.append(runs)
            cuts = {0, times}
            for runs in slots:
                at = 0
                for _, _, n in runs:
                    at += n
                    cuts.add(at)
            order = sorted(cuts)
            state = [[0, 0] for _ in slots]  # of each slot: its run, items taken from it
            for a, b in zip(order[:-1], order[1:], strict=True):
                offset = 0
                for runs, s in zip(slots, state, strict=True):
                    if s[0] < len(runs):
                        x, rank, n = runs[s[0]]
                        places.append((x, rank + s[1], rank + s[1] + b - a, bins + a, 1, offset))
                        offset += x
                        s[1] += b - a
                        if s[1] == n:
                            s[0], s[1] = s[0] + 1, 0
                release(capacity - offset, bins + a, b - a, offset)
            bins += times
        rest: dict[int, list[tuple[int, int]]] = {}
        for q in queues:
            for x, rank, n in q:
                rest.setdefault(x, []).append((rank, n))
    else:
        rest = {}
    rounded = set(large)
    for x in counts:
        if x not in rounded:
            rest[x] = [(0, counts[x])]
    for x in sorted(rest, reverse=True):
        for rank, n in rest[x]:
            while n:
                i = bisect_left(rooms, x)
                if i == len(rooms):
                    room, first, many, offset = capacity, bins, -(-n // (capacity // x)), 0
                    bins += many
                else:
                    room = rooms[i]
                    first, many, offset = free[room].pop()
                    if not free[room]:
                        del free[room], rooms[i]
                each = room // x
                whole = min(many, n // each)
                if whole:
                    places.append((x, rank, rank + whole * each, first, each, offset))
                    release(room - each * x, first, whole, offset + each * x)
                    rank, n = rank + whole * each, n - whole * each
                if whole < many and n:
                    some = n  # fewer than a bin holds
                    places.append((x, rank, rank + some, first + whole, some, offset))
                    release(room - some * x, first + whole, 1, offset + some * x)
                    rank, n, whole = rank + some, 0, whole + 1
                release(room, first + whole, many - whole, offset)
    return places


def table_of(spark: SparkSession, places: list[Place]) -> DataFrame:
    """The places as a table. It goes as an Arrow table, since rows of Python are read by workers of their own, which stay beside those of the tasks."""
    names = ["_length", "_from", "_to", "_bin", "_each", "_offset"]
    columns = zip(*places, strict=True) if places else [[]] * len(names)
    return spark.createDataFrame(pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, columns, strict=True)}))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text", seed: int = 31) -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` tokens: a row for each piece of a document, with its token ids.

    ``ids`` holds them as 32-bit little-endian numbers, of which ``ids_crc32`` is the checksum; a
    sequence is the ``ids`` of its ``sequence_id`` joined in order of ``offset``. A document is its ids and the end token; only longer ones are cut, into pieces of ``capacity``.
    The lengths' counts, at most ``capacity`` rows, come to the driver and return as a table of places
    (bounded by the different lengths); pieces meet their place by length and by rank among the
    pieces of that length, in order of a seeded hash. ``sequence_id`` and ``offset`` follow.

    Null texts count as empty and hold only the end token; null keys and repeated rows are packed
    like others (equal pieces are interchangeable); other columns are ignored; no rows, no pieces.
    """
    spark = docs.sparkSession
    pieces = keep(pieces_of(docs, tokenizer, capacity, key, text))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = F.broadcast(table_of(spark, plan(counts, capacity)))
    pieces = pieces.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32"))
    # ids travel with their piece: a bucket of 4096 tokens a piece is about 8 MB, 16 MB with ids of 4 bytes
    at = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", "_h", per_bucket=1000)
    out = at.join(places, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    out = out.withColumn("sequence_id", F.expr("_bin + (_rank - _from) div _each")).withColumn("offset", F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length"))
    out = out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    with open(tokenizer, encoding="utf-8") as f:
        return widened(out) if id_bytes(f.read(), 1) == 2 else out
