"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reviewlens.llm.common import _LOWER, gathered, in_python, keep, text_buffers
from reviewlens.llm.packing import slices

#: Bytes of a sequence in training. In prediction long texts are read in runs of ``INNER`` bytes side by side, whose
#: states are settled by segments of ``SEGMENT`` bytes.
STEPS, INNER, SEGMENT = 32, 1024, 64
#: Positions that are held at once, and texts or runs that are read together.
POSITIONS, TOGETHER = 1 << 20, 4096
#: Bytes of text that are predicted together, so that many texts share the fixed cost of a step.
BYTES = 4 << 20
#: In prediction states are multiples of 2^-10 and recurrent weights of 2^-8, so that their sums of products are exact
#: in single precision: a state depends neither on what is read beside it nor on the order of the additions.
#: No gate opens beyond ``GATE``, so that what a state was fades at each byte and the network forgets a wrong one soon.
GATE = np.float32(0.875)
WEIGHT, ROUND = 256, np.float32(12288)  # the neighbours of 12288 in single precision are 2^-10 apart


@dataclass
class Network:
    """``e``: a byte's share in the three gates, by direction; ``u``: the state's; ``v``: the labels' weights."""

    labels: list[str]
    e: np.ndarray  # 2, 256, 3h
    u: np.ndarray  # 2, h, 3h
    b: np.ndarray  # 2, h: the candidate's inner bias
    v: np.ndarray  # 2h, labels
    c: np.ndarray  # labels


def _gate(x):
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, GATE)


def _run(net, seq, way, inside, tape):
    """The states (steps, sequences, h) of one direction over ``seq`` (steps, sequences); ``tape`` takes what training needs.

    Gates are piecewise linear: update z, reset r, candidate k; h' = k + z (h - k). ``inside``: which
    places hold text; elsewhere the state is nothing, so a text begins and ends as if it stood alone.
    """
    whole = inside.all(axis=1)
    n = net.b.shape[1]
    e, u, b = net.e[way], net.u[way], net.b[way]
    h = np.zeros((seq.shape[1], n), np.float32)
    states = np.empty((*seq.shape, n), np.float32)
    order = range(len(seq)) if way == 0 else range(len(seq) - 1, -1, -1)
    for t in order:
        x, y = e[seq[t]], h @ u
        zr = x[:, : 2 * n] + y[:, : 2 * n]
        g = _gate(zr)
        inner = y[:, 2 * n :] + b
        pre = x[:, 2 * n :] + g[:, n:] * inner
        k = np.clip(pre, -1, 1)
        tape.append((t, h, zr, g, inner, pre, k))
        h = k + g[:, :n] * (h - k)
        if not whole[t]:
            h *= inside[t][:, None]
        states[t] = h
    return states


def _soft(x):
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _learn_step(net, seq, mask, goal):
    """Loss and gradients of one batch by backpropagation through time; every position has its text's label."""
    n = net.b.shape[1]
    tapes = ([], [])
    states = [_run(net, seq, way, mask, tapes[way]) for way in (0, 1)]
    both = np.concatenate(states, axis=2)
    p = _soft(both @ net.v + net.c)
    weight = (mask / mask.sum())[:, :, None]
    hit = np.zeros_like(p)
    hit[:, np.arange(seq.shape[1]), goal] = 1
    loss = -float((np.log(p + 1e-9) * hit * weight).sum())
    d = (p - hit) * weight
    grads = {"e": np.zeros_like(net.e), "u": np.zeros_like(net.u), "b": np.zeros_like(net.b), "v": both.reshape(-1, 2 * n).T @ d.reshape(-1, d.shape[2]), "c": d.sum(axis=(0, 1))}
    back = d @ net.v.T
    for way in (0, 1):
        dh = np.zeros((seq.shape[1], n), np.float32)
        for t, h, zr, g, inner, pre, k in reversed(tapes[way]):
            dh = (dh + back[t, :, way * n : (way + 1) * n]) * mask[t][:, None]
            z, r = g[:, :n], g[:, n:]
            dk = dh * (1 - z) * (np.abs(pre) < 1)
            dg = np.concatenate([dh * (h - k), dk * inner], axis=1) * (0.25 * ((zr > -2) & (zr * 0.25 + 0.5 < GATE)))
            dx = np.concatenate([dg, dk], axis=1)
            dy = np.concatenate([dg, dk * r], axis=1)
            np.add.at(grads["e"][way], seq[t], dx)
            grads["u"][way] += h.T @ dy
            grads["b"][way] += (dk * r).sum(axis=0)
            dh = dh * z + dy @ net.u[way].T
    return loss, grads


def fit(texts: list[bytes], labels: list[str], hidden: int = 8, rounds: int = 350, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
    """Train on random sequences of the texts, as many of each label, by Adam."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    by = [[x for x, y in zip(texts, labels, strict=True) if y == name] for name in names]
    f = np.float32
    net = Network(
        names,
        (rng.normal(0, 0.5, (2, 256, 3 * hidden))).astype(f),
        (rng.normal(0, 0.5 / np.sqrt(hidden), (2, hidden, 3 * hidden))).astype(f),
        np.zeros((2, hidden), f),
        (rng.normal(0, 0.5, (2 * hidden, len(names)))).astype(f),
        np.zeros(len(names), f),
    )
    slots = {x: (np.zeros_like(getattr(net, x)), np.zeros_like(getattr(net, x))) for x in "eubvc"}
    for step in range(1, rounds + 1):
        goal = rng.integers(0, len(names), batch)
        seq, mask = np.zeros((batch, STEPS), np.uint8), np.zeros((batch, STEPS), f)
        for i, g in enumerate(goal):
            x = by[g][rng.integers(len(by[g]))]
            a = int(rng.integers(max(1, len(x) - STEPS + 1)))
            x = _LOWER[np.frombuffer(x[a : a + STEPS], np.uint8)]
            seq[i, : len(x)], mask[i, : len(x)] = x, 1
        _, grads = _learn_step(net, seq.T, mask.T, goal)
        now = rate * min(1.0, 2 - 2 * step / rounds)
        for x, g in grads.items():
            m, s = slots[x]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            fixed = (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            setattr(net, x, (getattr(net, x) - now * fixed).astype(f))
    return net


def exact(net: Network) -> Network:
    """The network for prediction: recurrent weights rounded, the gates' slope and middle put into their weights."""
    n = net.b.shape[1]
    most = 32 / n
    e, u = net.e.copy(), np.rint(np.clip(net.u, -most, most) * WEIGHT) / WEIGHT
    e[..., : 2 * n] = e[..., : 2 * n] * 0.25 + 0.5
    u[..., : 2 * n] *= 0.25
    return replace(net, e=e.astype(np.float32), u=u.astype(np.float32))


def _follow(net, seq, way, inside, h):
    """The states of one direction over ``seq`` (steps, sequences) from ``h`` on, by an exact network."""
    n = net.b.shape[1]
    # by gate, so that every step goes over whole arrays
    e = np.ascontiguousarray(net.e[way].reshape(256, 3, n).transpose(1, 0, 2))
    u = np.ascontiguousarray(net.u[way].reshape(n, 3, n).transpose(1, 0, 2))
    b = np.ascontiguousarray(np.broadcast_to(net.b[way], (seq.shape[1], n)))
    whole = inside.all(axis=1)
    states = np.empty((*seq.shape, n), np.float32)
    x, y = np.empty((2, 3, seq.shape[1], n), np.float32)
    gates, k = x[:2], y[2]
    for t in range(len(seq)) if way == 0 else range(len(seq) - 1, -1, -1):
        np.take(e, seq[t], axis=1, out=x, mode="clip")
        np.matmul(h, u, out=y)
        gates += y[:2]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, GATE, out=gates)
        k += b
        k *= x[1]
        k += x[2]
        np.maximum(k, -1, out=k)
        np.minimum(k, 1, out=k)
        now = states[t]
        np.subtract(h, k, out=now)
        now *= x[0]
        now += k
        now += ROUND
        now -= ROUND
        if not whole[t]:
            now *= inside[t][:, None]
        h = now
    return states


def pooled(net: Network, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The label probabilities of each text of a batch: the mean over all its positions.

    Both directions' states go through the whole text, whatever its length. Long texts are first read
    in runs side by side, each from nothing; then every segment whose neighbour ends in another state
    than it began with is read again from that state, until none differs. Every state is then, bit by
    bit, that of one pass over the text. A trained network forgets, so this ends some segments behind
    a run's start; one that never forgets is read on from end to end.
    """
    net, raw = exact(net), _LOWER[raw]
    size = np.diff(at)
    many = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    n = net.b.shape[1]
    # by segment: the states on entering and on leaving it, in both directions, and its sums of probabilities
    enter, leave = (np.zeros((2, len(text), n), np.float32) for _ in (0, 1))
    sums = np.zeros((len(text), len(net.labels)))
    ones = np.ones(len(net.labels), np.float32)
    # states are within one of nothing, so logits are bounded, and mostly no exponential can overflow
    far = bool((np.abs(net.v).sum(axis=0) + np.abs(net.c)).max() > 40)

    def read(first, count):
        """``count`` segments from each of ``first`` on, as far as the texts go."""
        length = np.minimum(count * SEGMENT, size[text[first]] - nth[first] * SEGMENT)
        # by length, so that those read together need few steps past their ends
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        a = 0
        while a < len(first):
            k = -(-int(length[a]) // SEGMENT)
            b = slice(a, a + min(TOGETHER, max(1, POSITIONS // (k * SEGMENT))))
            a = b.stop
            begin, long = first[b], length[b]
            steps = np.arange(k * SEGMENT)[:, None]
            inside = steps < long
            seq = raw[np.minimum(at[text[begin]] - at[0] + nth[begin] * SEGMENT + steps, len(raw) - 1)]
            # what is shorter than the longest one ends its text, behind which there is nothing
            ahead = _follow(net, seq, 0, inside, enter[0, begin])
            behind = _follow(net, seq, 1, inside, enter[1, begin + (long - 1) // SEGMENT])
            for j in range(k):
                here = slice(j * SEGMENT, (j + 1) * SEGMENT)
                live, on = (int((long > m * SEGMENT).sum()) for m in (j, j + 1))
                which = begin[:live] + j
                f, r = ahead[here, :live], behind[here, :live]
                leave[0, which], leave[1, which] = f[-1], r[0]
                if on and j + 1 < k:
                    enter[0, which[:on] + 1], enter[1, which[:on]] = f[-1, :on], behind[here.stop, :on]
                x = f @ net.v[:n]
                x += r @ net.v[n:]
                x += net.c
                if far:
                    x -= x.max(axis=2, keepdims=True)
                np.exp(x, out=x)
                x *= (inside[here, :live] / (x @ ones))[:, :, None]
                sums[which] = x.sum(axis=0)

    read(np.flatnonzero(nth % (INNER // SEGMENT) == 0), INNER // SEGMENT)
    follows = nth > 0
    ahead = behind = np.flatnonzero(follows)
    while True:
        # of those behind or before what was read, each that its neighbour leaves in another state than it entered
        ahead = ahead[(enter[0, ahead] != leave[0, ahead - 1]).any(axis=1)]
        behind = behind[(enter[1, behind - 1] != leave[1, behind]).any(axis=1)] - 1
        if not len(ahead) and not len(behind):
            break
        enter[0, ahead], enter[1, behind] = leave[0, ahead - 1], leave[1, behind + 1]
        again = np.union1d(ahead, behind)
        read(again, 1)
        ahead, behind = again[again + 1 < len(text)] + 1, again[follows[again]]
        ahead = ahead[follows[ahead]]
    total = np.zeros((len(size), len(net.labels)))
    for k in range(sums.shape[1]):
        total[:, k] = np.bincount(text, sums[:, k], minlength=len(size))
    return total / np.maximum(size, 1)[:, None]


#: Bounds of the training sample: texts of each label, characters of each, and texts in all, which many labels share.
TEXTS, CHARACTERS, SAMPLE = 400, 400, 40_000


def held_out(key):
    """Whether a row is never learned from: the CRC-32 of its key as text is divisible by 5 (a null key's too)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 0


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from a sample of the labelled rows that aren't held out; None where there are none.

    The sample is bounded: of each label about ``TEXTS`` rows, those of the lowest hash of their key,
    of each row a passage of ``CHARACTERS`` around a hashed place. Every label is learned; more than 100
    share ``SAMPLE`` rows evenly, and more than ``SAMPLE`` labels are an error.
    """
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"), docs[lang].cast("string").alias("l")).where(~held_out(F.col("k")) & F.col("l").isNotNull() & F.col("t").isNotNull() & (F.col("t") != ""))
    counts = keep(rows.groupBy(F.col("l").alias("_l")).agg(F.count(F.lit(1)).alias("n")))
    labels = counts.count()
    if labels > SAMPLE:
        raise ValueError(f"{labels} labels are more than the {SAMPLE} texts of the sample")
    texts = max(1, min(TEXTS, SAMPLE // max(1, labels)))
    h = F.shiftrightunsigned(F.xxhash64("k", F.lit(3)), 11).cast("double") / float(1 << 53)
    near = rows.join(F.broadcast(counts), F.col("l") == F.col("_l")).withColumn("h", h)
    # about so many of each label, and never none: a label's row of the lowest hash is among them
    least = keep(near.groupBy("_l").agg(F.min("h").alias("_h")).withColumnRenamed("_l", "_l2"))
    near = near.join(F.broadcast(least), F.col("l") == F.col("_l2")).where((F.col("h") * F.col("n") < texts) | (F.col("h") == F.col("_h")))
    place = F.pmod(F.xxhash64("k", F.lit(4)), F.greatest(F.length("t") - CHARACTERS, F.lit(1))).cast("int")
    passages = near.select("h", "k", "l", F.substring("t", place + 1, F.lit(CHARACTERS)).alias("t"))
    # the bound is within a label, so that many rows of one key, which share a hash, push no other label out
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "k", "t"))
    sample = passages.withColumn("nth", nth).where(F.col("nth") <= 2 * texts).orderBy("h", "k", "t").collect()
    if not sample:
        return None
    return fit([r["t"].encode() for r in sample], [r["l"] for r in sample])


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, its pooled probability, to every row, by the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text where there is no
    network. Of equal probabilities the first label in order is taken. Added columns replace others.
    """
    docs = docs.drop("lang_pred", "score")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text].cast("string").alias("text"), F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias("_any"))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if net is None:
        return rows.select("_row.*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        for batch in gathered(batches, "text", BYTES):
            for part in slices(batch, "text", BYTES):
                p = pooled(net, *text_buffers(part.column(1)))
                any_letter = part.column(2).to_numpy(zero_copy_only=False)
                best = p.argmax(axis=1)
                names = [net.labels[k] if ok else "und" for k, ok in zip(best.tolist(), any_letter.tolist(), strict=True)]
                score = np.where(any_letter, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["_row", "lang_pred", "score"])

    return rows.transform(in_python, run, T.StructType([rows.schema["_row"], *fields])).select("_row.*", "lang_pred", "score")
