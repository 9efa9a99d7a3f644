"""Byte-level BPE by prefix dynamic programming: the one valid last token of every byte prefix.

A sequence of tokens is what merging by rank gives exactly where every token, and every pair of
neighbours, is what merging gives of its own bytes. So each prefix of a piece has one valid last
token: the token that ends there and follows the last token of the prefix before it. Tokens are read
off backwards. A prefix's token depends on nothing behind it, so that text may be appended, and an
edit leaves what lies before it, and behind the next border of pieces, as it was.
"""

from __future__ import annotations

import re
from base64 import b64decode
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from reviewlens.llm.common import in_python

#: Units, and pieces, that a task remembers (pairs of tokens: four times as many), and the most characters of one that is worth it; they bound memory, not results.
REMEMBERED, SHORT = 400_000, 64
#: Characters that are encoded at a time.
SLICE = 2 << 20


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` lies in sorted ``keys``, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tables:
    """What many pieces are encoded by at once; as large as the vocabulary.

    An automaton of all tokens gives each prefix the tokens that end it: a state is the longest end of
    the prefix that begins a token, ``fail`` the next shorter one. ``left`` and ``right`` are the two
    tokens that a token was merged of, ``joined`` those that any two tokens make side by side.
    """

    def __init__(self, ranks: bytes):
        rank = {b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.rank = rank
        coder = Coder(self, "")
        top = max(rank.values()) + 1
        self.size, self.left, self.right, self.order = (np.full(top, x, np.int32) for x in (0, -1, -1, -1))
        sound, joined = {}, {}
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    joined[a << 32 | b] = r
            halves = coder.halves(t)
            if halves is not None:
                sound[t] = r
                self.size[r] = len(t)
                if halves:
                    self.left[r], self.right[r], self.order[r] = rank[halves[0]], rank[halves[1]], r
        flat = [b""] * top
        for t, r in rank.items():
            flat[r] = t
        self.bytes, self.first_byte = np.frombuffer(b"".join(flat), np.uint8), np.cumsum([0, *map(len, flat)])
        self.join_keys = np.array(sorted(joined), np.int64)
        self.join_rank = np.array([joined[k] for k in self.join_keys.tolist()], np.int32)
        states: dict[bytes, int] = {b"": 0}
        for t in sorted(sound, key=len):
            for i in range(1, len(t) + 1):
                states.setdefault(t[:i], len(states))
        by_size = sorted(states, key=len)
        fail, ends = np.zeros(len(states), np.int32), {0: ()}
        for text in by_size[1:]:
            state, tail = states[text], text[1:]
            while tail not in states:
                tail = tail[1:]
            fail[state] = states[tail]
            own = sound.get(text)
            ends[state] = ends[states[tail]] if own is None else (own, *ends[states[tail]])
        self.fail = fail
        edges = sorted((states[x[:-1]] << 8 | x[-1], states[x]) for x in by_size[1:])
        self.edge_keys, self.edge_to = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32)
        self.ends = np.array([t for k in range(len(states)) for t in ends[k]], np.int32)
        self.first_end = np.concatenate([[0], np.cumsum([len(ends[k]) for k in range(len(states))])]).astype(np.int32)
        #: whether tokens are merged of tokens of lower rank, which ``may_follow`` goes by
        self.by_rank = bool((np.maximum(self.order[self.left], self.order[self.right]) < self.order)[self.order >= 0].all())

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The automaton's states after one more byte each."""
        out, todo, state = np.zeros(len(state), np.int32), np.arange(len(state)), state.astype(np.int64)
        while len(todo):
            at, ok = _find(self.edge_keys, state << 8 | byte[todo])
            out[todo[ok]] = self.edge_to[at[ok]]
            go = ~ok & (state > 0)
            todo, state = todo[go], self.fail[state[go]].astype(np.int64)
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves tokens ``a`` and ``b`` side by side apart.

        Time runs by rank. Going back, the one of the two that was merged last is taken apart; what then met at
        the border must not have been a token of lower rank than that merger (of an equal one, the left goes first).
        """
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), 1 << 40)
        while len(todo):
            at, there = _find(self.join_keys, a << 32 | b)
            bad = there & (self.join_rank[at] < until)
            ok[todo[bad]] = False
            ra, rb = self.order[a], self.order[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go].astype(np.int64), rb[go].astype(np.int64)
            right_last = rb >= ra
            until = np.where(right_last, rb + 1, ra)
            a, b = np.where(right_last, a, self.right[a]), np.where(right_last, self.left[b], b)
        return ok


class Coder:
    """Encodes, decodes, appends and edits; what it has encoded it remembers.

    ``pattern`` cuts texts into pieces; none of its pieces may hold white space behind anything else.
    """

    def __init__(self, tables: Tables, pattern: str):
        import regex

        self.rank, self.tables = tables.rank, tables
        self.token = {r: t for t, r in self.rank.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in self.token}
        #: the sizes of the tokens that end with three bytes, or are shorter and end with fewer; the longest first
        sizes = defaultdict(set)
        for t in self.rank:
            sizes[t[-3:]].add(len(t))
        self.sizes = {tail: tuple(sorted(set().union(*(sizes.get(tail[i:], ()) for i in range(3))), reverse=True)) for tail in sizes}
        self.pieces, self.border = regex.compile(pattern), regex.compile(r"(?<=\S)(?=\s)")
        self.indented = re.compile(r"\s ")
        #: which tokens may follow a token (-1: begin a piece), and how many pairs that is; the ids of units and of pieces
        self.fit: dict[int, dict[int, bool]] = defaultdict(dict)
        self.pairs = 0
        self.known, self.known_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.units: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The tokens of a few bytes by merging the pair of lowest rank, the leftmost of equals, until ``least`` or no pair is left."""
        rank, never = self.rank.get, 1 << 62
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while len(pairs) >= least and (lowest := min(pairs)) != never:
            i = pairs.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def halves(self, token: bytes) -> list[bytes] | None:
        """The two tokens of which merging makes a token last; none for a byte; None if merging doesn't make it."""
        parts = self.merged(token, 2) if len(token) > 1 else []
        return parts if len(parts) in (0, 2) else None

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``, or (-1) begin a piece."""
        own = self.token[token]
        return self.merged(own) == [own] if before < 0 else self._may(-1, token) and self.merged(self.token[before] + own) == [self.token[before], own]

    def _may(self, before: int, token: int) -> bool:
        fit = self.fit[before]
        ok = fit.get(token)
        if ok is None:
            if self.pairs >= 4 * REMEMBERED:
                self.fit.clear()
                self.pairs, fit = 0, self.fit[before]
            self.pairs += 1
            ok = fit[token] = self._fits(before, token)
        return ok

    def last_tokens(self, data: bytes, done: Iterable[int] = ()) -> list[int]:
        """The last token of each prefix of a piece; ``done``: those of its first prefixes, where known."""
        last, rank, sizes, fit = list(done), self.rank, self.sizes, self.fit
        for end in range(len(last) + 1, len(data) + 1):
            tail = data[max(end - 3, 0) : end]
            while tail not in sizes:
                tail = tail[1:]
            for size in sizes[tail]:
                if size <= end and (token := rank.get(data[end - size : end])) is not None:
                    before = last[end - size - 1] if size < end else -1
                    ok = fit[before].get(token)
                    if ok or ok is None and self._may(before, token):
                        last.append(token)
                        break
        return last

    def read_off(self, last: list[int]) -> bytes:
        """The ids of a text from the last tokens of its pieces' prefixes, a number for each byte of the text."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(self.packed[token])
            at -= len(self.token[token])
        return b"".join(out[::-1])

    # --- whole texts ---

    def _slices(self, text: str) -> Iterator[str]:
        """A text in slices of about ``SLICE`` characters, cut at borders of pieces where there are any."""
        at = 0
        while len(text) - at > SLICE and (cut := self.border.search(text, at + SLICE)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _pairs(self, key: np.ndarray) -> np.ndarray:
        """Whether the second token of each pair (first << 32 | second) may follow the first; each pair is judged once."""
        at, there = _find(self.known, key)
        if not there.all():
            new = np.unique(key[~there])
            ok = self.tables.may_follow(new >> 32, new & 0xFFFFFFFF)
            known = np.concatenate([self.known, new]) if len(self.known) < 4 * REMEMBERED else np.unique(key)
            ok = np.concatenate([self.known_ok, ok]) if len(known) > len(new) and len(self.known) < 4 * REMEMBERED else self.tables.may_follow(known >> 32, known & 0xFFFFFFFF)
            by = np.argsort(known, kind="stable")
            self.known, self.known_ok = known[by], ok[by]
            at, _ = _find(self.known, key)
        return self.known_ok[at]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pieces at once: place by place, in all of them together."""
        size = np.array([len(p) for p in pieces], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        data, t = np.frombuffer(b"".join(pieces), np.uint8), self.tables
        last, state, longest = np.zeros(len(data), np.int64), np.zeros(len(pieces), np.int32), np.argsort(-size, kind="stable")
        left = np.searchsorted(-size[longest], -np.arange(1, size.max() + 1), side="right")
        for place, n in enumerate(left.tolist()):
            own = longest[:n]
            at = first[own] + place
            state[own] = t.step(state[own], data[at])
            option, end, todo = t.first_end[state[own]].astype(np.int64), t.first_end[state[own] + 1], np.arange(n)
            while len(todo):
                token = t.ends[option[todo]].astype(np.int64)
                back = t.size[token]
                fits = back == place + 1
                rest = np.flatnonzero(~fits)
                fits[rest] = self._pairs(last[at[todo[rest]] - back[rest]] << 32 | token[rest])
                last[at[todo[fits]]] = token[fits]
                todo = todo[~fits]
                option[todo] += 1
                if (option[todo] >= end[todo]).any():
                    raise ValueError("the vocabulary lacks a byte")
        # tokens end at a piece's end and, from there, a token's size before each end
        marked, at, begin = np.zeros(len(data), bool), first[1:] - 1, first[:-1]
        while len(at):
            marked[at] = True
            at = at - t.size[last[at]]
            at, begin = at[at >= begin], begin[at >= begin]
        ids = last[marked].astype("<u4").tobytes()
        cut = (4 * np.concatenate([[0], np.cumsum(marked)])[first]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _learn(self, units: list[str]) -> None:
        """The ids of new units."""
        of = [self.pieces.findall(u) for u in units]
        new = list(set(chain.from_iterable(of)).difference(self.ids))
        short = [p for p in new if len(p) <= SHORT] if self.tables.by_rank else []
        if short:
            self.ids.update(zip(short, self._encode_pieces([p.encode() for p in short]), strict=True))
        for p in new:
            if p not in self.ids:
                self.ids[p] = self.read_off(self.last_tokens(p.encode()))
        ids = self.ids.__getitem__
        self.units.update(zip(units, [b"".join(map(ids, pieces)) for pieces in of], strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts, as little-endian unsigned 32-bit integers; what is new in all of them is encoded once."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts, size = [], 0
        for i, text in enumerate(texts):
            for part in self._slices(text or ""):
                parts.append((i, part))
                size += len(part)
                if size > SLICE:
                    self._encode(parts, out)
                    parts, size = [], 0
        self._encode(parts, out)
        return [b"".join(x) for x in out]

    def _encode(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Distinct units, what lies between the spaces of the texts, each with the space before it; no piece crosses them."""
        raw = [text.encode() for _, text in parts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return
        begin = np.cumsum([0, *map(len, raw)])
        starts = data == 32
        for k, (_, text) in enumerate(parts):
            # behind white space a space begins nothing: the borders are looked for one by one
            if self.indented.search(text):
                cuts = [0, *(m.start() for m in self.border.finditer(text))]
                sizes = [len(text[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                starts[begin[k] : begin[k + 1]] = False
                starts[begin[k] + np.cumsum(sizes, dtype=np.int64)] = True
        starts[begin[:-1][np.diff(begin) > 0]] = True
        starts = np.flatnonzero(starts)
        units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        which, units = units.indices.to_numpy(zero_copy_only=False), units.dictionary.to_pylist()
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > REMEMBERED:
            self.units.clear()
            new = units
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        self._learn(new)
        of = [self.units[u] for u in units]
        size, flat = np.array([len(x) // 4 for x in of]), np.frombuffer(b"".join(of), "<u4")
        first, ends = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(size[which])])
        ids = flat[np.repeat(first[which] - ends[:-1], size[which]) + np.arange(ends[-1])].tobytes()
        cut = (4 * ends[np.searchsorted(starts, begin)]).tolist()
        for (i, _), a, b in zip(parts, cut[:-1], cut[1:], strict=True):
            out[i].append(ids[a:b])
        for u in [u for u in new if len(u) > SHORT]:
            del self.units[u]
            for p in self.pieces.findall(u):
                if len(p) > SHORT:
                    self.ids.pop(p, None)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[bytes | None]) -> list[bytes]:
        """The bytes that sequences of ids stand for."""
        t = self.tables
        numbers = np.frombuffer(b"".join([x or b"" for x in ids]), "<u4").astype(np.int64)
        size = t.first_byte[numbers + 1] - t.first_byte[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = np.empty(ends[-1], np.uint8)
        for a in range(0, len(numbers), SLICE):
            b = min(a + SLICE, len(numbers))
            shift = np.repeat(t.first_byte[numbers[a:b]] - ends[a:b], size[a:b])
            data[ends[a] : ends[b]] = t.bytes[shift + np.arange(ends[a], ends[b])]
        data, cut = data.tobytes(), ends[np.cumsum([0, *(len(x or b"") // 4 for x in ids)])].tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    # --- texts that change ---

    def prefixes(self, text: str | None) -> np.ndarray:
        """For each byte of a text: the last token of its piece's prefix that ends there."""
        out: list[int] = []
        for part in self._slices(text or ""):
            for p in self.pieces.findall(part):
                out += self.last_tokens(p.encode())
        return np.array(out, "<u4")

    def edited(self, text: str, last: np.ndarray, start: int, end: int, new: str) -> tuple[str, np.ndarray]:
        """The text with its characters from ``start`` to ``end`` replaced by ``new``, and its prefixes' tokens.

        Only what lies between the borders of pieces round the edit is cut into pieces again, and of the
        piece that the edit changes only the prefixes that reach into it are computed.
        """
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        fresh, moved = text[:start] + new + text[end:], len(new) - (end - start)
        a = start - 1
        while a > 0 and not self.border.match(text, a):
            a -= 1
        a, behind = max(a, 0), self.border.search(text, end + 1)
        b = behind.start() if behind else len(text)
        byte = len(text[:a].encode())
        before, after = last[:byte], last[byte + len(text[a:b].encode()) :]
        old = {a + m.start(): a + m.end() for m in self.pieces.finditer(text[a:b])}
        middle, at = [before], a
        for piece in self.pieces.findall(fresh[a : b + moved]):
            data, done = piece.encode(), 0
            if at < start and at in old:
                done = len(piece[: min(old[at], start) - at].encode())
            middle.append(np.array(self.last_tokens(data, last[byte : byte + done].tolist()), "<u4"))
            at, byte = at + len(piece), byte + len(data)
        return fresh, np.concatenate([*middle, after])


# --- tables --------------------------------------------------------------------

def _with(df: DataFrame, ranks: str, pattern: str, names: list[str], of: list[str], values) -> DataFrame:
    """``df`` with the binary columns ``names``, which replace columns of that name in any case; ``values(coder, *lists)`` of the columns ``of``.

    The tables, a few megabytes by the size of the vocabulary, travel with the function.
    """
    with open(ranks, "rb") as f:
        tables = Tables(f.read())
    taken = {n.lower() for n in names}
    rows = df.select([c for c in df.columns if c.lower() not in taken] + [F.col(c).alias(f"_of{i}") for i, c in enumerate(of)])
    kept = rows.columns[: len(rows.columns) - len(of)]

    def run(batches):
        coder = Coder(tables, pattern)
        for batch in batches:
            n = len(kept)
            out = values(coder, *[batch.column(n + i).to_pylist() for i in range(len(of))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(x, pa.binary()) for x in out]], [*kept, *names])

    schema = StructType([*rows.schema.fields[: len(kept)], *[StructField(n, BinaryType()) for n in names]])
    return rows.transform(in_python, run, schema)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids``: a text's ids as little-endian unsigned 32-bit integers; null counts as empty. Rows stay where they are."""
    return _with(df, ranks, pattern, ["ids"], [text], lambda coder, t: [coder.encode_all(t)])


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes that the ids stand for; null ids are none."""
    return _with(df, ranks, pattern, ["decoded"], [ids], lambda coder, x: [coder.decode_all(x)])


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode``, and ``decode`` of what it gives, in one pass over the texts: adds ``ids`` and ``decoded``."""

    def values(coder, texts):
        ids = coder.encode_all(texts)
        return ids, coder.decode_all(ids)

    return _with(df, ranks, pattern, ["ids", "decoded"], [text], values)


def prefixes(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``last``: for each byte of the text the last token of its piece's prefix, four bytes each; what ``edit`` goes on from."""
    return _with(df, ranks, pattern, ["last"], [text], lambda coder, t: [[coder.prefixes(x).tobytes() for x in t]])


def edit(df: DataFrame, ranks: str, pattern: str, start: str, end: str, new: str, text: str = "text", last: str = "last") -> DataFrame:
    """Texts with the code points from ``start`` to ``end`` replaced by ``new``: ``text``, ``last`` and ``ids`` of the result.

    Exact, and encodes only near the edit. Places outside a text are moved to its ends, null ones to its
    end, so that a row with nothing but ``new`` appends; a null ``new`` is empty.
    """

    def values(coder, *columns):
        out = []
        for t, state, a, b, more in zip(*columns, strict=True):
            t = t or ""
            a = len(t) if a is None else a
            fresh, after = coder.edited(t, np.frombuffer(state or b"", "<u4"), a, len(t) if b is None else b, more or "")
            out.append((fresh.encode(), after.tobytes(), coder.read_off(after.tolist())))
        return list(zip(*out, strict=True)) or [[], [], []]

    out = _with(df, ranks, pattern, ["_edited", "last", "ids"], [text, last, start, end, new], values)
    return out.withColumn(text, F.col("_edited").cast("string")).drop("_edited")
