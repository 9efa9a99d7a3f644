"""Byte-level BPE against the library whose ids it must give."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from reviewlens.llm import byte_bpe, queries
from tests.llm.helpers import none, odd, odd_rows

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "b", " ", "  ", "\n", " \n ", "'", "'s", "'ll", "ll", "é", "日", "🙂", "1", "²", ".", "...", "=" * 70, "　", "the ", "ing", "x" * 90, " " * 200, "\x1c", "\x85", "\0", "<|endoftext|>"]


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return byte_bpe.Coder(byte_bpe.Tables(f.read()), PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(own.encode_ordinary(text or ""), "<u4").tobytes()


def some_text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))


def test_ids_are_the_librarys(coder, library):
    rng = random.Random(1)
    texts = [some_text(rng, 30) for _ in range(400)] + [t for _, t, *_ in odd_rows()] + ["q" * 30_000, "ab" * 20_000, None, ""]
    ids = coder.encode_all(texts)
    assert ids == [library(t) for t in texts]
    assert coder.decode_all(ids) == [(t or "").encode() for t in texts]


def test_every_class_of_character(coder, library):
    texts = [f"a{chr(c)}1{chr(c)}b {chr(c)}.{chr(c)} {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert coder.encode_all(texts) == [library(t) for t in texts]


def test_small_memory_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    monkeypatch.setattr(byte_bpe, "SLICE", 50)
    rng = random.Random(2)
    texts = [some_text(rng, 60) for _ in range(100)]
    assert byte_bpe.Coder(coder.tables, PATTERN).encode_all(texts) == [library(t) for t in texts]


def test_neighbours_are_judged_as_merging_does(coder):
    rng = random.Random(3)
    ids = [i for i in coder.token if len(coder.token[i]) < 12]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(4000)] + [(i, i) for i in ids[:500]]
    quick = coder.tables.may_follow(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert quick.tolist() == [coder.merged(coder.token[a] + coder.token[b]) == [coder.token[a], coder.token[b]] for a, b in pairs]


def test_each_prefix_has_one_last_token(coder, library):
    for text in ("unbelievable", "international", "日本語", "====-----", "aaaaaaaaaaaaa"):
        last = coder.last_tokens(text.encode())
        for n in range(1, len(last) + 1):
            part = text.encode()[:n]
            if not any(c & 0xC0 == 0x80 for c in text.encode()[n : n + 1]):
                assert coder.read_off(last[:n]) == library(part.decode())


def test_edits_and_appends_are_exact(coder, library):
    rng = random.Random(4)
    for _ in range(300):
        text = some_text(rng, 30)
        last = coder.prefixes(text)
        for _ in range(3):
            a = rng.randint(0, len(text))
            text, last = coder.edited(text, last, a, rng.choice([a, rng.randint(a, len(text)), len(text)]), some_text(rng, 4))
            assert coder.read_off(last.tolist()) == library(text)
            assert last.tolist() == coder.prefixes(text).tolist()


def test_an_edit_encodes_only_near_itself(coder, monkeypatch):
    text = "one two three " * 2000 + "z" * 5000
    last = coder.prefixes(text)
    seen = []
    whole = byte_bpe.Coder.last_tokens
    monkeypatch.setattr(byte_bpe.Coder, "last_tokens", lambda self, data, done=(): seen.append(len(data) - len(done)) or whole(self, data, done))
    coder.edited(text, last, 14_000, 14_001, "xx")
    coder.edited(text, last, len(text), len(text), "zz")
    assert sum(seen) < 60


def test_tables(spark, library):
    docs = odd(spark).withColumn("IDS", F.lit("clash"))
    done = byte_bpe.round_trip(docs, RANKS, PATTERN)
    assert set(docs.columns) - {"IDS"} | {"ids", "decoded"} == set(done.columns)
    rows = done.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert bytes(r.ids) == library(r.text) and bytes(r.decoded) == (r.text or "").encode()
    again = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again)
    assert byte_bpe.round_trip(none(spark), RANKS, PATTERN).count() == 0


def test_edits_of_a_table(spark, library):
    docs = odd(spark).select("doc_id", "text")
    changes = byte_bpe.prefixes(docs, RANKS, PATTERN).select("*", (F.col("doc_id") % 7).alias("a"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 11).alias("b"), F.when(F.col("doc_id") % 5 > 0, F.lit(" it's")).alias("new"))
    for r in byte_bpe.edit(changes, RANKS, PATTERN, "a", "b", "new").collect():
        assert bytes(r.ids) == library(r.text)
    assert byte_bpe.edit(changes.limit(0), RANKS, PATTERN, "a", "b", "new").count() == 0


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op11_byte_bpe(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids, data = library(texts[r.doc_id]), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest())
