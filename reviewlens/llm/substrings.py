"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A reference block is a slice of texts. Its index holds sampled phrases: of the runs of ``GRAM`` words
in each window of ``window`` words, the one of the lowest hash, so that equal windows sample equal
phrases. Every text is parsed greedily against its block: from the first window that the index has
earlier, a factor goes on for as long as the words of both places agree; it is at least a window
long, and the windows across its end, beginning with the one a word too long, are looked up next. So
a text is a row of factors and of words between them. What a block holds once is asked of the index
of all blocks, dealt by phrase: phrases that only one place holds end the matter for their windows;
the windows at the others meet by their hash, each block's once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm import bloom
from reviewlens.llm.common import BROADCAST_ROWS, Scratch, in_python, keep, small, text_buffers, window_hashes, word_hashes, word_spans, words
from reviewlens.llm.packing import slices

GRAM = 6
#: Kinds of rows that parsing a block leaves.
PHRASE, KNOWN, WINDOW, REPEAT = range(4)
SCHEMA = "kind int, h long, doc_id long, rk long, pos int, n int"
#: Words that are compared at once where a factor goes on.
STRIDE = 32


def _windows(raw, at, window):
    """Of each window: its first word, its text, its hash, and its phrase's place; and the phrases' hashes."""
    start, end, first = word_spans(raw, at)
    h = word_hashes(raw, start, end)
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint64), first, h
    whole, grams = window_hashes(h, window), window_hashes(h, GRAM)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    s = np.flatnonzero(doc[: len(h) - window + 1] == doc[window - 1 :])
    views = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1)
    place = np.concatenate([views[a : a + 65536].argmin(axis=1) for a in range(0, len(views), 65536)])[s] + s
    return s, doc[s], whole[s], place, grams, first, h


def _batch(kind, h, doc=None, rk=None, pos=None, n=None):
    rows = len(h)
    doc, rk = (pa.nulls(rows, pa.int64()) if x is None else x for x in (doc, rk))
    pos, n = (pa.nulls(rows, pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (pos, n))
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), pa.array(h.astype(np.uint64).view(np.int64)), doc, rk, pos, n], ["kind", "h", "doc_id", "rk", "pos", "n"])


def _later(h, doc, pos):
    """Which rows have an equal hash with a smaller (doc, pos), which are the first of their hash, and where that first row is."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = np.zeros(len(h), bool)
    later[order] = (doc > doc[head]) | (pos > pos[head])
    lead = np.zeros(len(h), bool)
    lead[order] = new
    source = np.zeros(len(h), np.int64)
    source[order] = order[head]
    return later, lead, source


def factors(h: np.ndarray, first: np.ndarray, hit: np.ndarray, source: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parse all texts of a block greedily: each factor's first word, its words, and the word where its earlier copy begins.

    ``h``: the words' hashes, text after text; ``first``: each text's first word (n + 1); ``hit``: places
    where the block's index has an earlier equal window, which begins at ``source``. A text's factor
    begins at its next such place and goes on while the words agree; the search goes on from the
    window across its end. All texts are parsed side by side, a factor each at a time. A place whose
    words differ after all, which only equal hashes of different windows give, is no factor.
    """
    end_of = np.repeat(first[1:], np.diff(first))
    following = np.full(len(h) + 1, len(h), np.int64)
    following[hit] = hit
    following = np.minimum.accumulate(following[::-1])[::-1]
    copy = np.zeros(len(h), np.int64)
    copy[hit] = source
    at, stop = first[:-1].copy(), first[1:]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        at = following[np.minimum(at, len(h))]
        alive = at < stop
        at, stop = at[alive], stop[alive]
        if not len(at):
            break
        here, there = at, copy[at]
        room = np.minimum(stop - here, end_of[there] - there)
        size, going = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(going):
            step = size[going][:, None] + np.arange(STRIDE)
            inside = step < room[going][:, None]
            same = inside & (h[np.where(inside, here[going][:, None] + step, 0)] == h[np.where(inside, there[going][:, None] + step, 0)])
            run = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
            size[going] += run
            going = going[run == STRIDE]
        long = size >= window
        out.append((here[long], size[long], there[long]))
        at = here + np.where(long, size - window + 1, 1)
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parse(window):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = text_buffers(part.column(2))
                s, doc, whole, place, grams, first, h = _windows(raw, at, window)
                if not len(s):
                    continue
                ids, rk = part.column(0), part.column(1)
                of = ids.to_numpy(zero_copy_only=False)
                chosen = np.unique(place)
                phrase, back, times = np.unique(grams[chosen], return_inverse=True, return_counts=True)
                often = np.zeros(len(grams), bool)
                often[chosen] = times[back] > 1
                # asked of all blocks: phrases that this one holds once
                once = chosen[~often[chosen]]
                owner = pa.array(np.searchsorted(first, once, side="right") - 1)
                yield _batch(PHRASE, grams[once], None, rk.take(owner))
                yield _batch(KNOWN, phrase[times > 1])
                near = often[place]
                s, doc, whole = s[near], doc[near], whole[near]
                pos = s - first[doc]
                later, lead, source = _later(whole, of[doc], pos)
                own = pa.array(doc[lead])
                yield _batch(WINDOW, whole[lead], ids.take(own), rk.take(own), pos[lead])
                begin, size, _ = factors(h, first, s[later], s[source[later]], window)
                doc = np.searchsorted(first, begin, side="right") - 1
                own = pa.array(doc)
                yield _batch(REPEAT, np.zeros(len(own), np.uint64), ids.take(own), rk.take(own), begin - first[doc], size)

    return run


def _shared(batches):
    """Of rows sorted by phrase: the asked ones whose phrase stands in another block too. Only a batch's last row is held."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select(["rk", "h"])
        h = batch.column(1).to_numpy()
        before = np.concatenate([[h[0] == last], h[1:] == h[:-1]])
        if held is not None and before[0]:
            yield held
        twice = before.copy()
        twice[:-1] |= before[1:]
        hit = twice & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(hit))
        end = batch.slice(batch.num_rows - 1)
        held = end if not twice[-1] and end.column(0)[0].is_valid else None
        last = h[-1]


def _look_up(window):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s, doc, whole, place, grams, first, _ = _windows(*text_buffers(part.column(2)), window)
                if not len(s):
                    continue
                lists = part.column(3)
                flat, border = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                hit = np.zeros(len(s), bool)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                of = grams[place]
                for i in range(part.num_rows):
                    a, b = bounds[i], bounds[i + 1]
                    hit[a:b] = np.isin(of[a:b], flat[border[i] : border[i + 1]])
                own = pa.array(doc[hit])
                yield _batch(WINDOW, whole[hit], part.column(0).take(own), part.column(1).take(own), (s - first[doc])[hit])

    return run


def _resolve(batches):
    """Of rows sorted by window, then place: the places of all but the first. Only the first place of the window at hand is held."""
    head = None  # window, doc, pos
    for batch in batches:
        if not batch.num_rows:
            continue
        h, doc, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("h", "doc_id", "pos"))
        at = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        first_doc, first_pos = doc[at].copy(), pos[at].copy()
        if head is not None and head[0] == h[0]:
            first_doc[0], first_pos[0] = head[1:]
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        later = (doc > first_doc[of]) | (pos > first_pos[of])
        yield batch.select(["doc_id", "rk", "pos"]).filter(pa.array(later))
        head = (h[-1], first_doc[-1], first_pos[-1])


def _remove(window, text):
    import re

    # the driver's pattern travels to the workers; the words are those of SPACE_CLASS
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts = batch.column(0).field(text).cast(pa.string())
            for one, places, copy in zip(texts, batch.column(1), batch.column(2), strict=True):
                w = word.findall(one.as_py() or "")
                gone = np.zeros(len(w) + 1, np.int32)
                if copy.as_py() and len(w) >= window:
                    gone[0] = 1
                elif places.is_valid:
                    spans = places.values
                    begin, size = spans.field(0).to_numpy(), spans.field(1).to_numpy()
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + size, -1)
                stays = np.cumsum(gone)[:-1] == 0
                n_words.append(len(w))
                n_removed.append(int((~stays).sum()))
                kept.append(" ".join(x for x, y in zip(w, stays.tolist(), strict=True) if y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["_row", "n_words", "n_removed", "kept_text"])

    return run


#: A null key counts as this one, larger than any other.
NO_KEY = (1 << 63) - 1


def deduplicate(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_removed`` and ``kept_text`` (the kept words, joined by one space) to every row.

    Removed is each word in a window of ``window`` words whose words also start earlier: at a smaller
    ``key``, or earlier in a row of the same key. Whole copies of a text with a smaller key are
    settled by the text's hash alone. Then blocks of texts are parsed into factors: what a block repeats
    is settled there; one row for each sampled phrase and block asks whether other blocks hold it;
    of shared phrases, the windows are looked up, each block sending a window once. No group exceeds
    the number of blocks, whatever share of the rows holds a passage, and groups are read as sorted
    streams, a batch at a time.

    Null and empty texts have no words. A null key counts as the largest; rows of one key and place
    are ties, and neither is earlier. Texts may be of any length. Added columns replace others.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept_text")
    columns = [docs[c] for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_row"), F.coalesce(docs[key].cast("long"), F.lit(NO_KEY)).alias("doc_id"), F.xxhash64(docs[text]).alias("th"))
    rows = rows.withColumn("rk", F.xxhash64("doc_id", "th"))
    with Scratch(spark) as tmp:
        slim = rows.select("doc_id", "th", "rk", F.col("_row")[text].cast("string").alias("text")).where("text is not null")
        # whole copies: only the text's smallest key is parsed
        heads = slim.groupBy("th").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last")
        heads = small(heads.select(F.col("th").alias("_t"), "head"), BROADCAST_ROWS)
        single, maybe = bloom.split(slim, "th", heads.select("_t"))
        maybe = maybe.join(heads, maybe["th"] == heads["_t"], "left").where("head is null or doc_id = head")
        parsed = single.select("doc_id", "rk", "text").unionByName(maybe.select("doc_id", "rk", "text"))
        found = tmp.write(parsed.transform(in_python, _parse(window), SCHEMA), "found")
        asked = found.where(F.col("kind").isin(PHRASE, KNOWN)).select("h", "rk")
        shared = asked.repartition("h").sortWithinPartitions("h").transform(in_python, _shared, "rk long, h long")
        wanted = tmp.write(shared.groupBy(F.col("rk").alias("_k")).agg(F.collect_list("h").alias("hs")), "wanted")
        _, texts = bloom.split(parsed, "rk", wanted.select("_k"))
        texts = texts.join(wanted, texts["rk"] == wanted["_k"]).select("doc_id", "rk", "text", "hs")
        looked = texts.transform(in_python, _look_up(window), SCHEMA).unionByName(found.where(F.col("kind") == WINDOW))
        repeats = looked.select("h", "doc_id", "rk", "pos").repartition("h").sortWithinPartitions("h", "doc_id", "pos").transform(in_python, _resolve, "doc_id long, rk long, pos int")
        repeats = repeats.withColumn("n", F.lit(window)).unionByName(found.where(F.col("kind") == REPEAT).select("doc_id", "rk", "pos", "n"))
        gone = keep(repeats.groupBy(F.col("doc_id").alias("_i"), F.col("rk").alias("_k")).agg(F.collect_list(F.struct("pos", "n")).alias("_at")))
    copied = rows.join(heads.withColumnRenamed("_t", "_t2"), F.col("th") == F.col("_t2"), "left")
    copied = copied.withColumn("_copy", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False))).drop("_t2", "head", "th")
    whole, part = copied.where("_copy"), copied.where("not _copy")
    clear, touched = bloom.split(part, "rk", gone.select("_k"))
    touched = touched.join(gone, (F.col("doc_id") == F.col("_i")) & (F.col("rk") == F.col("_k")), "left").select("_row", "_at", "_copy")
    touched = touched.unionByName(whole.select("_row", F.lit(None).cast(gone.schema["_at"].dataType).alias("_at"), "_copy"))
    clear = clear.withColumn("_w", words(F.col("_row")[text].cast("string"))).select("_row.*", F.size("_w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("_w", " ").alias("kept_text"))
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([touched.schema["_row"], *added])
    place = [c.lower() for c in docs.columns].index(text.lower())
    return clear.unionByName(touched.transform(in_python, _remove(window, place), schema).select("_row.*", "n_words", "n_removed", "kept_text"))
