"""N-gram Jaccard join with set relations: block skipping by position, answers derived from similar sets.

Sets of shingles are joined exactly. Each set's prefix, its first shingles in one global order, goes
to lists by shingle; sets that link share one. Lists give each set a home, the leader with which it
shares most of them, and so collapse groups of copies: only homes, never sets, are paired, and lists
are cut into blocks where sizes and positions leave no link between their sets. For each pair of
homes the sets meet in one place; a set's overlaps with a home's sets are derived from the home's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm import bloom
from reviewlens.llm.common import _LOWER, Scratch, grouped, in_python, keep, mix, text_buffers, word_hashes, word_spans
from reviewlens.llm.packing import slices

#: A shingle in about this share of all sets, by counts over all of them, comes last in the order.
HEAVY = 1 / 500
#: Bytes of text whose shingles are hashed at once; bounds memory, not results.
SLICE = 3 << 19
#: Sets of the corpus for each part of a heavy shingle's list: no list in one task can hold more than about so many.
SETS_A_PART = 250_000
#: Shingles and sets of each block of a home; the blocks of larger homes meet pair by pair.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 2_000
#: Sets of a home meet another home by classes of sizes, each up to so many times the one before.
CLASS = 1.15
#: Shingles that a set shares with a leader by chance: with fewer it doesn't go there.
CHANCE = 2
#: Words of 64 bits of a set's sketch.
LANES = 8
SKETCH = [f"b{i}" for i in range(LANES)]


def shingle_sets(raw, at, size):
    """Each text's distinct shingles, as sorted hashes: one array, and each text's first (n + 1)."""
    raw = _LOWER[raw]
    start, end, first = word_spans(raw, at)
    h = word_hashes(raw, start, end)
    n = np.diff(first)
    mixed = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(mixed)]
    doc = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(doc[: len(mixed)] == doc[size - 1 :]) if len(mixed) else np.zeros(0, np.int64)
    of, value = doc[whole], mix(mixed[whole])
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k, d in enumerate(few):
            x = np.array([n[d]], np.uint64)
            for w in h[first[d] : first[d + 1]]:
                x = mix(x + w)
            short[k] = x[0]
        of, value = np.concatenate([of, few]), np.concatenate([value, short])
    if len(few):
        order = np.argsort(of, kind="stable")
        of, value = of[order], value[order]
    border = np.searchsorted(of, np.arange(len(n) + 1))
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        value[a:b].sort()
    if len(of):
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])])
        of, value = of[new], value[new]
    return value, np.searchsorted(of, np.arange(len(n) + 1))


def sketches(value, first):
    """A bitmap of each set that isn't empty: a bit is set where an odd number of its shingles fall on it (one array a word).

    A shingle that one of two sets has alone flips one bit, so they differ in no more bits than shingles.
    """
    begin = first[:-1][np.diff(first) > 0]
    if not len(begin):
        return [np.zeros(0, np.uint64)] * LANES
    bit, lane = np.uint64(1) << (value & np.uint64(63)), (value >> np.uint64(6)) % np.uint64(LANES)
    return [np.bitwise_xor.reduceat(np.where(lane == i, bit, np.uint64(0)), begin) for i in range(LANES)]


def _apart(shingles, per):
    """The most shingles that one alone of two linked sets has, which hold so many together."""
    return shingles * (100 - per) // (100 + per)


def _sets(size, whole=True):
    """Of texts: the shingles of each set, with its first text in a task; or, not ``whole``, a slim row for each text and one for each frequent shingle."""

    def run(batches):
        seen, frequent = set(), _Frequent()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                value, first = shingle_sets(*text_buffers(part.column(2)), size)
                n = np.diff(first)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value))])
                sid = mix((sums[first[1:]] - sums[first[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)).view(np.int64)
                new = []
                for i in np.flatnonzero(n):
                    if sid[i] not in seen:
                        seen.add(sid[i])
                        new.append(i)
                if whole:
                    tokens = pa.array([value[first[i] : first[i + 1]].tobytes() for i in new], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(sid[new]), tokens], ["sid", "tokens"])
                    continue
                frequent.add([value[first[i] : first[i + 1]] for i in new])
                hot = pa.nulls(part.num_rows, pa.int64())
                sketch = np.zeros((LANES, len(n)), np.uint64)
                sketch[:, n > 0] = sketches(value, first)
                columns = [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(sid, mask=n == 0), hot, *[pa.array(x.view(np.int64)) for x in sketch]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "n", "sid", "hot", *SKETCH])
        if not whole:
            hot, times = frequent.found()
            none = pa.nulls(len(hot), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(times), none, pa.array(hot), *[none] * LANES], ["id", "th", "n", "sid", "hot", *SKETCH])

    return run


def _unpack(column):
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
    sizes = np.array([len(x) // 8 for x in column.to_pylist()], np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


class _Frequent:
    """The shingles of more than ``HEAVY`` of a partition's sets, with how many hold them: any of more than that of all sets is among some partition's."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, sets):
        self.n += len(sets)
        if sets:
            value, times = np.unique(np.concatenate(sets), return_counts=True)
            self.held.append((value[times > 1], times[times > 1]))

    def found(self):
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        value, times = np.concatenate([x for x, _ in self.held]), np.concatenate([y for _, y in self.held])
        value, back = np.unique(value, return_inverse=True)
        total = np.bincount(back, times, minlength=len(value)).astype(np.int64)
        hot = total > max(2, self.n * HEAVY)
        return value[hot].view(np.int64), total[hot]


def _need(a, b, per):
    """The least overlap of sets of a and b shingles that link."""
    return -(-per * (a + b) // (100 + per))


def _more(n):
    """Shingles that a prefix has beyond the shortest exact one: linked sets share at least the fewer of theirs.

    With prefixes longer by m, sets that overlap enough share not one shingle of them but m, which sets that only
    share a passage rarely do. It is also bounded by the overlap itself.
    """
    return 2 + n // 25


def _spare(n, per):
    """Shingles that a set of ``n`` may leave out of its prefix, if all leave out those that most sets have.

    With any set that it links with it shares one more in their prefixes (``_more`` of the smaller, or all of the overlap).
    What either leaves out of these are the most frequent ones, in one order for both, so the rarest stays in both.
    """
    return F.least(2 + F.floor(per * n / 2500), F.ceil(per * n / 100)) - 1


def _fewest(low, high, other_low, other_high, per, least=np.minimum, greatest=np.maximum):
    """A bound for how many shingles of their prefixes two linked sets share, one of ``low`` to ``high`` shingles, one of ``other_low`` to ``other_high``.

    Of the set whose prefix ends first in the order, all shared shingles up to there are in both prefixes, so what they
    share beyond is no more than what its prefix leaves out: less than ``per / 100 - 1 / 25`` of it (``_more``). The bound
    is least for the smallest set with the largest that it can link with, or with one of its own size.
    """
    small = greatest(least(low, other_low), per * greatest(low, other_low) / 100)
    large = greatest(small, least(greatest(high, other_high), 100 * least(least(high, other_high), small) / per))
    shared = lambda n: per * (small + n) / (100 + per) - max(0, per / 100 - 1 / 25) * n
    return least(shared(small), shared(large))


def _prefixes(size, per, heavy, parts):
    """Of texts: the prefixes of their sets, a row a shingle.

    Sets and prefixes are made in one go: as two steps, each task would hold two Python workers, and
    sets would pass from the one to the other through the JVM.
    """

    def run(batches):
        for batch in _sets(size)(batches):
            if not batch.num_rows:
                continue
            flat, first = _unpack(batch.column(1))
            n = np.diff(first)
            of = np.repeat(np.arange(len(n)), n)
            hot = np.isin(flat, heavy)
            # by hash, heavy ones last: a set's shingles are sorted already, so counting gives the places
            calm = np.concatenate([[0], np.cumsum(~hot)])
            rank = calm[:-1] - calm[first[of]]
            place = np.where(hot, np.arange(len(flat)) - first[of] - rank + (calm[first[1:]] - calm[first[:-1]])[of], rank)
            taken = place < np.minimum(n, n - -(-per * n // 100) + _more(n))[of]
            of, sid = of[taken], batch.column(0).to_numpy()
            hot, flat, place = hot[taken], flat[taken], place[taken]
            part = np.where(hot, 1 + sid[of] % parts, 0).astype(np.int32)
            for a in range(0, len(of), 200_000):
                b = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(flat[b].view(np.int64)), pa.array(part[b]), pa.array(sid[of[b]]), pa.array(n[of[b]].astype(np.int32)), pa.array(place[b].astype(np.int32))], ["h", "part", "sid", "n", "place"])

    return run


def _lists(per):
    """Of a partition by shingle and part: the rows of lists that hold two sets or more, with their leader.

    A list is sorted by size and cut into blocks where the next set is too large for the one before
    to link with; a block of one is dropped. ``often``: the sets of a shingle's whole list; a heavy one's has no end.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        h, part, sid, n, place = (rows.column(c).to_numpy() for c in ("h", "part", "sid", "n", "place"))
        order = np.lexsort((sid, n, part, h))
        h, part, sid, n, place = h[order], part[order], sid[order], n[order].astype(np.int64), place[order].astype(np.int64)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (100 * n[:-1] < per * n[1:])])
        twin = np.concatenate([[False], (sid[1:] == sid[:-1]) & ~new[1:]])  # one set, kept by two tasks
        block = np.cumsum(new)
        h, part, sid, n, place, block = (x[~twin] for x in (h, part, sid, n, place, block))
        often = np.where(part > 0, np.iinfo(np.int64).max, np.searchsorted(h, h, side="right") - np.searchsorted(h, h))
        _, begin, back, times = np.unique(block, return_index=True, return_inverse=True, return_counts=True)
        # a heavy shingle's list goes on in other parts, so a set alone in one isn't alone
        shared = (times[back] > 1) | (part > 0)
        lead = sid[begin][back]
        out = pa.Table.from_arrays([pa.array(x[shared]) for x in (h, part, sid, n, place, lead, often)], ["h", "part", "sid", "n", "place", "lead", "often"])
        yield from out.to_batches(max_chunksize=200_000)

    return run


def _home_pairs(per):
    """Of a partition by shingle: pairs of size classes of two homes with sets that may share it, and how many shingles each pair has so.

    A list's classes are sorted by their smallest set: past the reach of a class's largest set, the rest
    is skipped as one block, as are classes whose positions leave too few shingles after this one, even
    if it is the last of the ``_fewest``: these are counted for sure, which is all that is asked of a pair.
    Nor do classes meet whose sketches differ in more bits than links leave, the radius round each allowed
    for: sets that share a passage alone, as many as hold it, never become pairs.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        h, home, unit, low, high, left, radius = (rows.column(c).to_numpy() for c in ("h", "home", "unit", "low", "high", "left", "radius"))
        order = np.lexsort((low, h))
        h, home, unit, low, high, left, radius = (x[order] for x in (h, home, unit, low, high, left, radius))
        sketch = np.stack([rows.column(c).to_numpy()[order].view(np.uint64) for c in SKETCH], axis=1)
        end = np.searchsorted(h, h, side="right")
        ones, others, size = [], [], 0
        for i in np.flatnonzero(end - np.arange(len(h)) > 1):
            j = np.arange(i + 1, end[i])
            j = j[: np.searchsorted(low[j], 100 * high[i] // per, side="right")]
            j = j[100 * high[j] >= per * low[i]]
            most = np.ceil(np.maximum(_fewest(low[i], high[i], low[j], high[j], per), _more(np.minimum(high[i], high[j]))))
            j = j[np.minimum(left[i], left[j]) + most - 1 >= _need(low[i], low[j], per)]
            j = j[home[j] != home[i]]
            bits = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            j = j[bits - radius[i] - radius[j] <= _apart(high[i] + high[j], per)]
            if len(j):
                ones.append(np.minimum(unit[j], unit[i]))
                others.append(np.maximum(unit[j], unit[i]))
                size += len(j)
                if size > 1_000_000:
                    yield _counted(ones, others)
                    ones, others, size = [], [], 0
        if size:
            yield _counted(ones, others)

    return run


def _counted(ones, others):
    both = np.stack([np.concatenate(ones), np.concatenate(others)], axis=1)
    order = np.lexsort((both[:, 1], both[:, 0]))
    both = both[order]
    at = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)]))
    return pa.RecordBatch.from_arrays([pa.array(both[at, 0].copy()), pa.array(both[at, 1].copy()), pa.array(np.diff(np.append(at, len(both))).astype(np.int64))], ["a", "b", "c"])


def meet(tokens, sides, per):
    """Links, a spanning forest of them, between sets of side 0 and of side 1 (or of one side, all with all).

    ``tokens``: sorted arrays. The first set of side 0 is the base: what a set shares with it is
    computed once, and from that follow bounds on its overlap with every other set, so that most
    answers are derived; only the others are counted. Sets already joined are never compared.
    """
    n = np.array([len(t) for t in tokens], np.int64)
    links: list[tuple[int, int]] = []
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), n)
    value, back, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[back] > 1
    flat, owner = back[shared], owner[shared]
    order = np.lexsort((owner, flat))
    by_value, holders = flat[order], owner[order]  # index lists: the sets that hold each shared shingle
    first = np.searchsorted(by_value, np.arange(len(value) + 1))
    mine = np.searchsorted(owner, np.arange(len(tokens) + 1))

    def counts(i):
        own = flat[mine[i] : mine[i + 1]]
        size = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(holders[at], minlength=len(tokens))

    sides = np.asarray(sides)
    both = len(set(sides.tolist())) > 1
    base = int(np.flatnonzero(sides == sides.min())[0])
    of_base = counts(base)
    outer = np.maximum(n - of_base, 0)
    every = np.arange(len(tokens))
    root = every.copy()

    def join(i, found):
        for j in np.flatnonzero(found):
            if root[i] != root[j]:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
                links.append((i, j))

    for i in np.concatenate([[base], np.delete(every, base)]):
        if both:
            mates = sides != sides[i] if i == base else sides > sides[i]
        else:
            mates = every != i if i == base else every > i
        need = _need(n[i], n, per)
        todo = mates & (root != root[i]) & (np.minimum(n[i], n) >= need)
        if i == base:
            join(i, todo & (of_base >= need))
            continue
        todo &= np.minimum(of_base[i], of_base) + np.minimum(outer[i], outer) >= need
        join(i, todo & (of_base[i] + of_base - n[base] >= need))
        todo &= root != root[i]
        if todo.any():
            join(i, todo & (counts(i) >= need))
    return links


def _meetings(per):
    def run(batches):
        for group in grouped(batches, "meeting"):
            sid = group.column("sid").to_numpy()
            side, tokens = group.column("side").to_numpy(), group.column("tokens").to_pylist()
            _, one = np.unique(sid, return_index=True)  # a set that two tasks kept
            order = one[np.lexsort((sid[one] != group.column("lead").to_numpy()[one], side[one]))]
            sets = [np.frombuffer(tokens[k], np.uint64) for k in order]
            if len(sets) < 2:
                continue
            links = meet(sets, side[order], per)
            if links:
                a, b = sid[order[[x for x, _ in links]]], sid[order[[y for _, y in links]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (its component's smallest node) for all nodes of ``links`` (``a``, ``b``).

    Every edge to a larger neighbour moves to the smallest one known, then every edge to a smaller
    neighbour does, until nothing moves: all edges are then stars around the roots.
    """
    edges = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        lifted = large.join(low, "b")
        after = keep(lifted.select(F.col("m").alias("a"), "b").union(lifted.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct())
        if after.count() == edges.count() and not after.exceptAll(edges).limit(1).count():
            break
        edges = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def link(docs: DataFrame, size: int = 5, per: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``id``, ``th`` (a hash of the text), ``n_shingles``, ``component_id``, ``group``.

    A text's set holds its distinct shingles of ``size`` words, A-Z lower-cased; a shorter text is one
    shingle. Two rows link when 100 times their intersection is at least ``per`` times their union,
    and always when their sets are equal; ``component_id`` is the smallest key that links reach;
    ``group`` is equal within a component alone, and null without words.

    Rows without words link with nothing: their component is their own key. Null keys join
    components, which take their smallest key that is not null (null if there is none). Repeated
    rows are one set. Texts of any length are whole. Only components are computed, neither link pairs
    nor a row's number of links: sets that are already in one component are not compared again. All
    components are whole: no list, group or candidate is capped, and large homes meet in blocks.
    ``docs`` is read three times: shingles are made again from the texts, never stored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].cast("string").alias("text"))
    with Scratch(spark) as tmp:
        # shingles take twice the texts' bytes, so they are made of the texts again where they are read, and never stored
        first = tmp.write(rows.transform(in_python, _sets(size, False), "id long, th long, n long, sid long, hot long" + "".join(f", {c} long" for c in SKETCH)), "sets")
        sets, frequent = first.where("hot is null").drop("hot"), first.where("hot is not null")
        kept = rows.transform(in_python, _sets(size), "sid long, tokens binary")
        # bounded: at most (2 * mean set size / HEAVY) shingles can be in half of HEAVY of all sets
        n_sets = sets.agg(F.count_distinct("sid")).first()[0]
        heavy = frequent.groupBy(F.col("hot").alias("h")).agg(F.sum("n").alias("c")).where(F.col("c") > max(8, n_sets * HEAVY / 2))
        heavy = np.array(sorted(r["h"] for r in heavy.collect()), np.int64).view(np.uint64)
        prefixes = rows.transform(in_python, _prefixes(size, per, heavy, 1 + n_sets // SETS_A_PART), "h long, part int, sid long, n int, place int")
        lists = tmp.write(prefixes.repartition("h", "part").transform(in_python, _lists(per), "h long, part int, sid long, n long, place long, lead long, often long"), "lists")
        # a set goes to the leader with which it shares most, if more than chance; else it is its own home
        votes = lists.groupBy("sid", "lead").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        strong = (F.col("lead") != F.col("sid")) & (F.col("c") >= CHANCE + F.floor(F.col("n") / 100))
        home = votes.groupBy("sid").agg(F.min(F.when(strong, F.struct(-F.col("c"), "lead"))).alias("x"), F.max("n").alias("n"))
        home = keep(home.select("sid", F.coalesce("x.lead", "sid").alias("lead"), "n"))
        # leaders hand their sets on: those of a list's parts to the first of them, others to their own leader
        heads = lists.where("part > 0").select("h", "lead").distinct()
        heads = heads.join(heads.groupBy("h").agg(F.min("lead").alias("next")), "h").where("lead != next").groupBy("lead", "next").agg(F.count(F.lit(1)).alias("c"))
        first = heads.groupBy("lead").agg(F.max_by("next", F.struct("c", -F.col("next"))).alias("next"))
        own = home.select(F.col("sid").alias("lead"), F.col("lead").alias("next")).where("lead != next")
        for up in (first, own, own):
            home = home.join(up, "lead", "left").select("sid", F.coalesce("next", "lead").alias("lead"), "n")
        # what two homes share counts by classes of sizes, as the bounds on it follow the smallest and the largest set
        # a class lies round its leader's sketch; a set that can't link with the leader is a class of its own, round its own
        sketch = sets.where("sid is not null").groupBy("sid").agg(*[F.max(c).alias(c) for c in SKETCH])
        home = home.withColumnRenamed("lead", "home").join(sketch, "sid").join(sketch.select(F.col("sid").alias("home"), *[F.col(c).alias(f"of_{c}") for c in SKETCH]), "home")
        bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"of_{c}"))) for c in SKETCH), F.lit(0)).cast("long")
        close = F.when(bits <= F.floor(2 * F.col("n") * (100 - per) / (100 + per)), bits)
        unit = F.xxhash64("home", F.floor(F.log("n") / float(np.log(CLASS))), F.when(close.isNull(), F.col("sid")))
        home = home.select("sid", "home", "n", unit.alias("unit"), F.coalesce(close, F.lit(0)).alias("radius"), *[F.when(close.isNull(), F.col(c)).otherwise(F.col(f"of_{c}")).alias(c) for c in SKETCH])
        home = tmp.write(home, "home")
        around = tmp.write(home.groupBy("unit").agg(F.max("radius").alias("radius"), *[F.max(c).alias(c) for c in SKETCH]), "around")
        at = lists.select("h", "sid", "place", "often").join(home.select("sid", "home", "n", "unit"), "sid")
        # a set's most frequent shingles make no pairs, as far as links have others
        at = at.withColumn("nth", F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("often"), "h"))).where(F.col("nth") > _spare(F.col("n"), per))
        at = at.groupBy("h", "home", "unit").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("left")).join(around, "unit")
        pairs = at.repartition("h").transform(in_python, _home_pairs(per), "a long, b long, c long")
        pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"))
        # homes, and their classes, in blocks of bounded size
        blocks = lambda by: home.groupBy(F.col(by).alias("home")).agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m"), F.min("n").alias("low"), F.max("n").alias("high")).withColumn("k", F.ceil(F.greatest(F.col("w") / BLOCK_SHINGLES, F.col("m") / BLOCK_SETS)).cast("int"))
        weight, units = tmp.write(blocks("home"), "weight"), tmp.write(blocks("unit"), "units")
        alone = weight.where("m > 1").select(F.col("home").alias("a"), F.col("home").alias("b"), F.col("k").alias("ka"), F.col("k").alias("kb"))
        ka = units.select(F.col("home").alias("a"), F.col("k").alias("ka"), F.col("low").alias("la"), F.col("high").alias("ha"))
        kb = units.select(F.col("home").alias("b"), F.col("k").alias("kb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        low = F.least("la", "lb")
        need = F.ceil(per * (F.col("la") + F.col("lb")) / (100 + per))
        fewest = _fewest(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"), per, F.least, F.greatest)
        c = F.col("c") + _spare(F.greatest("ha", "hb"), per)
        pairs = pairs.join(ka, "a").join(kb, "b").where((c >= F.least(F.lit(2) + F.floor(low / 25), need)) & (c >= fewest))
        meetings = alone.union(pairs.select("a", "b", "ka", "kb"))
        meetings = meetings.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("kb") - 1))).where("a != b or i <= j")
        meetings = tmp.write(meetings.select("a", "b", "i", "j", F.xxhash64("a", "b", "i", "j").alias("meeting")), "meetings")
        sides = meetings.select("meeting", F.col("a").alias("home"), F.col("i").alias("block"), F.lit(0).alias("side"), F.col("a").alias("lead"))
        sides = sides.union(meetings.where("a != b or i != j").select("meeting", F.col("b").alias("home"), F.col("j").alias("block"), F.lit(1).alias("side"), F.col("a").alias("lead")))
        members = home.select("home", "sid").join(weight.select("home", "k"), "home").union(home.select(F.col("unit").alias("home"), "sid").join(units.select("home", "k"), "home"))
        members = members.select("home", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int").alias("block"), "sid")
        guests = tmp.write(members.join(sides, ["home", "block"]).select("sid", "meeting", "side", "lead"), "guests")
        _, needed = bloom.split(kept, "sid", guests.select("sid").distinct())
        # copies that several tasks kept are one set, before it goes to its meetings
        needed = needed.groupBy("sid").agg(F.first("tokens").alias("tokens"))
        there = needed.join(guests, "sid").select("meeting", "side", "lead", "sid", "tokens")
        met = there.repartition("meeting").sortWithinPartitions("meeting").transform(in_python, _meetings(per), "a long, b long")
        links = keep(met.distinct())
        slim = keep(sets.select("id", "th", "n", "sid"))
    roots = keep(components(links))
    slim = slim.join(roots, slim["sid"] == roots["node"], "left").select("id", "th", "n", F.coalesce("root", "sid").alias("group"))
    linked = slim.where("group is not null").groupBy(F.col("group").alias("r")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    out = slim.join(linked, slim["group"] == linked["r"], "left")
    return out.select("id", "th", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "group")


def keep_one(docs: DataFrame, size: int = 5, per: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest key, of equal keys the smallest hash of the text.

    Rows without words all stay. Repeated rows are copies of each other, so one of them stays: of rows
    of one key and text that differ in other columns, the one of the smallest hash. Rows that go are few; a Bloom filter of them lets most others pass without a shuffle.
    """
    labels = keep(link(docs, size, per, key, text).select("id", "th", "group"))
    worded = labels.where("group is not null")
    first = worded.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("x"))
    many = worded.groupBy("group", "id", "th").agg(F.count(F.lit(1)).alias("times"))
    many = many.join(first, "group").where("not (id <=> x.id and th <=> x.th) or times > 1")
    row = lambda i, t: F.xxhash64(i, t)
    gone = keep(many.select(row(F.col("id"), F.col("th")).alias("_g"), (F.col("id").eqNullSafe(F.col("x.id")) & F.col("th").eqNullSafe(F.col("x.th"))).alias("_one")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row(docs[key].cast("long"), F.xxhash64(docs[text])).alias("_k"))
    clear, maybe = bloom.split(rows, "_k", gone.select("_g"))
    maybe = maybe.join(gone, F.col("_k") == F.col("_g"), "left")
    stay = maybe.where("_g is null")
    # of repeated rows that stay, one: combined before the shuffle, however many there are
    one = maybe.where("_one").groupBy("_k").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return clear.select("_row.*").union(stay.select("_row.*")).union(one.select("_row.*"))
