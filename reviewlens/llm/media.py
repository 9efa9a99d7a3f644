"""Media columns: chroma audio fingerprints, and the alignment of recordings by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import in_python, keep

FRAME, HOP = 1024, 256
#: Filters over the pitch-class image, from a rule: (kind, first class, classes, frames).
FILTERS = [(k % 4, (5 * k) % 10, 2 + k % 3, 2 + 3 * (k % 4)) for k in range(16)]
#: Borders between the four levels of a filter's log ratio, and their Gray codes.
LEVELS, GRAY = np.array([-0.25, 0.0, 0.25]), np.array([0, 1, 3, 2], np.uint64)
#: Steps of the image's values: boxes of whole numbers are exact wherever in a recording they lie.
STEPS = 1 << 20
#: Frames that are transformed at once; bounds memory, not results.
TOGETHER = 512


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes (of one recording, or of several of one length), each frame of unit sum; none where there are too few samples.

    Every frame is transformed and summed by itself, so what it gives doesn't depend on its neighbours.
    """
    samples = np.asarray(samples)
    n = max(0, (samples.shape[-1] - FRAME) // HOP + 1)
    out = np.zeros((*samples.shape[:-1], n, 12))
    if not n:
        return out
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = np.flatnonzero((f >= 100) & (f <= min(3500, rate / 2)))
    of = np.round(12 * np.log2(f[heard] / 440)).astype(int) % 12
    bins = heard[np.argsort(of, kind="stable")]
    classes, first = np.unique(np.sort(of), return_index=True)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=-1)[..., ::HOP, :]
    window = np.hanning(FRAME).astype(samples.dtype)
    for a in range(0, n, TOGETHER):
        s = np.fft.rfft(frames[..., a : a + TOGETHER, :] * window, axis=-1)[..., bins]
        out[..., a : a + TOGETHER, classes] = np.add.reduceat(s.real * s.real + s.imag * s.imag, first, axis=-1)
    return out / (out.sum(axis=-1, keepdims=True) + 1e-12)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A packed integer of 32 bits for each frame (of each recording): sixteen filters of four levels over the integral image."""
    n = image.shape[-2]
    if not n:
        return np.zeros(image.shape[:-1], np.uint64)
    most = max(w for *_, w in FILTERS)
    whole = np.round(image * STEPS).astype(np.int64)
    total = np.zeros((*image.shape[:-2], n + most + 1, 13), np.int64)
    total[..., 1 : n + 1, 1:] = whole
    total[..., n + 1 :, 1:] = whole[..., -1:, :]
    total = total.cumsum(axis=-2).cumsum(axis=-1)
    # by column: one run of memory for each border of a box
    column = [np.ascontiguousarray(total[..., k]) for k in range(13)]

    def box(a, b, low, high):
        high = min(high, 12)
        band = column[high] - column[low]
        return band[..., b : b + n] - band[..., a : a + n]

    out = np.zeros(image.shape[:-1], np.uint64)
    for kind, y, h, w in FILTERS:
        top = min(y + 2 * h, 12)
        if kind == 0:  # lower classes against upper ones
            a, b = box(0, w, y, y + h), box(0, w, y + h, top)
        elif kind == 1:  # earlier frames against later ones
            a, b = box(0, w // 2, y, top), box(w // 2, w, y, top)
        elif kind == 2:  # a chequer of both
            a = box(0, w // 2, y, y + h) + box(w // 2, w, y + h, top)
            b = box(0, w // 2, y + h, top) + box(w // 2, w, y, y + h)
        else:  # the band against all
            a, b = box(0, w, y, y + h), box(0, w, 0, 12) / 3
        a, b = a + STEPS // 1000, b + STEPS // 1000
        level = sum((a > b * x).astype(np.int8) for x in np.exp(LEVELS))
        out = (out << np.uint64(2)) | GRAY[level]
    return out


def tones(values: np.ndarray, rate: int = 4000) -> np.ndarray:
    """A recording for a vector: each value sounds for a hop as one of 24 notes, a higher value as a higher note.

    Values from -0.3 to 0.3 span the notes, as the parts of unit vectors of some dozens of dimensions do; others sound as the nearest note, and one that is no number as 0.
    """
    note = np.clip(np.nan_to_num(np.asarray(values, float), nan=0.0, posinf=1.0, neginf=-1.0) * 40 + 12, 0, 23).astype(np.int64)
    return _notes(rate)[note].ravel()


def _notes(rate: int) -> np.ndarray:
    t = np.arange(HOP) / rate
    return np.sin(2 * np.pi * (220 * 2 ** (np.arange(24) / 12))[:, None] * t).astype(np.float32)


def prints_of(recordings: list[np.ndarray], rate: int) -> list[np.ndarray]:
    """Each recording's fingerprint; recordings of one length go through the filters together."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(recordings)
    by: dict[tuple, list[int]] = {}
    for i, x in enumerate(recordings):
        by.setdefault((len(x), x.dtype), []).append(i)
    for (size, _), own in by.items():
        many = max(1, 8 * TOGETHER // max(1, size // HOP))
        few = max(1, many // 8)
        for a in range(0, len(own), many):
            part = own[a : a + many]
            image = np.concatenate([chroma(np.stack([recordings[i] for i in part[b : b + few]]), rate) for b in range(0, len(part), few)])
            for i, p in zip(part, fingerprint(image), strict=True):
                out[i] = p
    return out


def fingerprints(recordings: DataFrame, key: str, column: str, decode, rate: int = 4000) -> DataFrame:
    """(``id``, ``frames``, ``fingerprint`` array of long) for each row; ``decode`` turns a cell's numbers into samples.

    Null and short recordings have no frames. Repeated ids and repeated rows are rows like others;
    recordings of any length are whole; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                prints = prints_of([decode(np.asarray(x.values, float)) if x.is_valid else np.zeros(0, np.float32) for x in part.column(1)], rate)
                flat = np.concatenate(prints).astype(np.int64)
                sizes = np.array([len(p) for p in prints], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], ["id", "frames", "fingerprint"])

    return in_python(recordings.select(recordings[key].cast("long").alias("id"), recordings[column].cast("array<double>").alias("x")), run, "id long, frames long, fingerprint array<long>")


#: An alignment of two classes is reported from so many equal integers at one offset on, and up to this share of
#: differing bits. Of pairs of unrelated vectors of the tables, 1 in 200,000 reaches both.
VOTES, BIT_ERROR = 5, 0.25
#: Frames of the queries that are asked at once, and equal pairs of frames that are counted at once; they bound memory, not results.
BLOCK_FRAMES, PAIRS = 1 << 19, 1 << 21
#: Classes that a task aligns with a block of queries.
TASK_CLASSES = 2000


class Block:
    """Queries as an index: their frames sorted by integer, with query and place."""

    def __init__(self, names: np.ndarray, size: np.ndarray, flat: np.ndarray):
        self.names, self.size, self.flat = names, size, flat
        self.first = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(self.flat, kind="stable")
        self.value, begin, many = np.unique(self.flat[order], return_index=True, return_counts=True)
        self.begin, self.many = begin, many
        owner = np.repeat(np.arange(len(size)), size)
        self.query, self.place = owner[order], (np.arange(len(self.flat)) - self.first[owner])[order]


def _histograms(block: Block, flat: np.ndarray, owner: np.ndarray, at: np.ndarray):
    """The offset histograms of some classes: for each (class, query) with an equal frame its best offset and votes.

    Equal pairs of frames are listed a bounded number at a time, and only counts are held between.
    """
    spot = np.minimum(np.searchsorted(block.value, flat), len(block.value) - 1)
    hit = np.flatnonzero(block.value[spot] == flat)
    spot, owner, at = spot[hit], owner[hit], at[hit]
    many = block.many[spot]
    low, width = int(block.size.max()), int(block.size.max() + (at.max() if len(at) else 0) + 1)
    asked, asks = block.query * width + low - block.place, owner * (len(block.size) * width) + at
    keys, counts = [], []
    total = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < len(spot):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
        reach = np.repeat(block.begin[spot[a:b]] - total[a:b], many[a:b]) + np.arange(total[a], total[b])
        key, n = np.unique(asked[reach] + np.repeat(asks[a:b], many[a:b]), return_counts=True)
        keys.append(key)
        counts.append(n)
        a = b
    if not keys:
        return (np.zeros(0, np.int64),) * 4
    key, votes = keys[0], counts[0]
    if len(keys) > 1:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        votes = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    pair, offset = key // width, key % width - low
    # most votes, then the nearest to 0, then the negative one
    near = 2 * np.abs(offset) + (offset > 0)
    span = 2 * width + 2
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    best = np.maximum.reduceat(votes * span + span - 1 - near, first)
    near = span - 1 - best % span
    pair = pair[first]
    return pair // len(block.size), pair % len(block.size), np.where(near % 2, near // 2, -(near // 2)), best // span


def _bit_errors(block: Block, flat, first, owner, query, offset) -> np.ndarray:
    """The share of differing bits where each pair overlaps at its offset."""
    here, there = np.maximum(-offset, 0), np.maximum(offset, 0)
    n = np.minimum(block.size[query] - here, np.diff(first)[owner] - there)
    out = np.zeros(len(n))
    total = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
        step = np.arange(total[a], total[b]) - np.repeat(total[a:b], n[a:b])
        x = block.flat[step + np.repeat(block.first[query[a:b]] + here[a:b], n[a:b])]
        y = flat[step + np.repeat(first[owner[a:b]] + there[a:b], n[a:b])]
        out[a:b] = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), total[a:b] - total[a]) / (32 * n[a:b])
        a = b
    return out


def _aligned(block: Block, votes: int, bit_error: float):
    names = ["q", "class_id", "offset", "votes", "bit_error", "reached"]

    def rows(query, class_id, offset, n, error, reached):
        arrays = [pa.array(block.names[query]), pa.array(class_id), pa.array(offset), pa.array(n), pa.array(error), pa.array(reached)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        top = None  # of each query: votes, class, offset, error
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                name, class_id, lists = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2)
                flat, first = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
                first = first - first[0]
                of = np.repeat(np.arange(len(class_id)), np.diff(first))
                owner, query, offset, n = _histograms(block, flat, of, np.arange(len(flat)) - first[of])
                other = name[owner] != block.names[query]
                owner, query, offset, n = owner[other], query[other], offset[other], n[other]
                if top is None:
                    top = [np.zeros(len(block.names), np.int64), np.zeros(len(block.names), np.int64), np.zeros(len(block.names), np.int64), np.zeros(len(block.names))]
                better = (n > top[0][query]) | ((n == top[0][query]) & (class_id[owner] < top[1][query]))
                many = n >= votes
                todo = better | many
                owner, query, offset, n, better, many = (x[todo] for x in (owner, query, offset, n, better, many))
                error = _bit_errors(block, flat, first, owner, query, offset)
                reached = many & (error <= bit_error)
                yield rows(query[reached], class_id[owner[reached]], offset[reached], n[reached], error[reached], np.ones(int(reached.sum()), bool))
                owner, query, offset, n, error = (x[better] for x in (owner, query, offset, n, error))
                order = np.lexsort((class_id[owner], -n, query))
                order = order[np.concatenate([[True], query[order][1:] != query[order][:-1]])] if len(order) else order
                for x, y in zip(top, (n, class_id[owner], offset, error), strict=True):
                    x[query[order]] = y[order]
        if top is not None:
            q = np.flatnonzero(top[0])
            yield rows(q, top[1][q], top[2][q], top[0][q], top[3][q], np.zeros(len(q), bool))

    return run


def align(prints: DataFrame, every: int = 20, votes: int = VOTES, bit_error: float = BIT_ERROR) -> DataFrame:
    """Adds ``class_id``, ``match_id``, ``offset``, ``bit_error``, ``matches``: equal fingerprints are one class, the smallest id.

    Queries are the rows whose id is divisible by ``every``, against all others, by class. Equal
    integers vote for the offset of their frames; the recording of the most votes at one offset, then
    the smaller id, is the match, and the error is the share of differing bits where both overlap.
    ``matches`` holds every class that aligns at its own best offset (most votes, then the nearest to
    0, then the negative one) with at least ``votes`` votes and at most ``bit_error``: ``bit_error``,
    ``match_id``, ``offset``, ``votes``, the lowest error first; empty if none does, null for rows
    that are no queries. The match of the most votes is given even where it reaches neither.

    The classes of the queries are asked in blocks of about ``BLOCK_FRAMES`` frames. A block, an index
    by integer, goes to all tasks as a broadcast of that size; each task counts its classes' offset
    histograms against it and returns the alignments that reach the thresholds and one best match a
    query, so votes are never shuffled, however many recordings share an integer. Copies are
    never paired: votes are counted between classes alone. Null ids and recordings without frames
    match nothing; so do queries without an equal integer; the rows of a repeated id have one answer
    each, by their own fingerprints.
    """
    spark = prints.sparkSession
    prints = keep(prints.withColumn("_h", F.xxhash64("fingerprint", "frames")))
    classes = prints.where("frames > 0 and id is not null").groupBy("_h").agg(F.min("id").alias("class_id"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"), F.first("fingerprint").alias("print"))
    classes = keep(classes)
    size = classes.agg(F.count(F.lit(1)), F.sum(F.when(F.col("asks") == 1, F.size("print")))).first()
    classes = keep(classes.repartition(max(1, -(-size[0] // TASK_CLASSES)), "_h"))
    blocks = -(-(size[1] or 0) // BLOCK_FRAMES)
    schema = "q long, class_id long, offset long, votes long, bit_error double, reached boolean"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        asked = classes.where((F.col("asks") == 1) & (F.pmod(F.xxhash64("_h"), F.lit(blocks)) == b)).select("_h", "print").toArrow()
        if asked.num_rows:
            lists = asked["print"].combine_chunks()
            sent = spark.sparkContext.broadcast((asked["_h"].to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()))
            run = lambda batches, sent=sent: _aligned(Block(*sent.value), votes, bit_error)(batches)
            found = found.unionByName(keep(classes.select("_h", "class_id", "print").transform(in_python, run, schema)))
            sent.unpersist()
    top = F.min(F.struct(-F.col("votes"), "class_id", "offset", "bit_error")).alias("t")
    matches = F.array_sort(F.collect_list(F.when(F.col("reached"), F.struct("bit_error", F.col("class_id").alias("match_id"), "offset", "votes")))).alias("matches")
    found = found.groupBy(F.col("q").alias("_q")).agg(top, matches).select("_q", F.col("t.class_id").alias("match_id"), "t.offset", "t.bit_error", "matches")
    out = prints.join(classes.select(F.col("_h").alias("_c"), "class_id"), F.col("_h") == F.col("_c"), "left")
    out = out.withColumn("_a", F.when(F.col("id") % every == 0, F.col("_h")))
    asks, rest = out.where("_a is not null"), out.where("_a is null")
    none = F.array().cast(found.schema["matches"].dataType)
    asks = asks.join(found, F.col("_a") == F.col("_q"), "left").drop("_q").withColumn("matches", F.coalesce("matches", none))
    return asks.unionByName(rest, allowMissingColumns=True).drop("_h", "_c", "_a")
