import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import packing, quality
from reviewlens.llm.common import text_buffers

from .helpers import none, odd, repeats, words

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_statistics_match_brute_force(spark):
    for r in quality.with_stats(odd(spark)).collect():
        w = words(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"] or ""), len(lines) - len(set(lines)), repeats(w))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_a_list_is_learned_and_ordered(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, F.repeat(F.lit("spam# spam$ "), 20)).when(F.col("id") % 7 == 1, F.repeat(F.concat(F.lit("ab1234567 x"), "id", F.lit(" ")), 1)).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("word"), i * F.col("id"))), " ")).alias("text"))
    labels = rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1).alias("quality"))
    rules = quality.learn_from(rows.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w#"), i * F.col("doc_id") + 1)), " "))).otherwise(F.col("text"))), labels)
    assert rules and all(isinstance(c, quality.Condition) for r in rules for c in r)
    assert quality.verdict([]) is not None


def test_learned_rules_keep_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.learn_from(docs, labels)
    out = quality.judge(docs, rules).join(labels, "doc_id").toPandas()
    free = out[~out.base_failed]
    assert (free[free.quality == 1].kept).mean() > 0.99
    assert (~free[free.quality == 0].kept).mean() > 0.8
    assert quality.learn_from(docs, labels.limit(0)) == []


def test_learned_rules_hold_on_labels_that_taught_nothing(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    rules = quality.learn_from(docs, labels.where(~held))
    out = quality.judge(docs, rules).join(labels.where(held), "doc_id").toPandas()
    free = out[~out.base_failed]
    assert len(free) > 60 and (free[free.quality == 1].kept).mean() > 0.97 and (~free[free.quality == 0].kept).mean() > 0.7


def test_a_step_of_covering_equals_brute_force(spark):
    """The first condition of a rule has the highest information gain of all thresholds, by plain counting."""
    rng = np.random.default_rng(4)
    x, y = rng.random(400), rng.random(400)
    bad = (x > 0.7) ^ (rng.random(400) < 0.05)
    cuts = {"a": sorted(np.quantile(x, np.arange(1, 10) / 10).tolist()), "b": sorted(np.quantile(y, np.arange(1, 10) / 10).tolist())}
    counts = [{"f": f, "b": k, "p": int(bad[at == k].sum()), "n": int((~bad[at == k]).sum())} for f, v in (("a", x), ("b", y)) for at in [np.searchsorted(cuts[f], v)] for k in range(10)]
    got, _ = quality._best(counts, cuts)
    best = None
    for f, v in (("a", x), ("b", y)):
        for cut in cuts[f]:
            for above in (False, True):
                hit = v > cut if above else v <= cut
                p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
                if p:
                    gain = p * (np.log2(p / (p + n)) - np.log2(bad.sum() / 400))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, above, cut)
    assert (got.feature, got.above, got.threshold) == best[1:]


def test_statistics_beside_columns_of_their_own_names(spark):
    docs = spark.createDataFrame([("a b", 1, 2, 3)], "text string, _w int, _l int, n_words int")
    r = quality.with_stats(docs).first()
    assert (r["_w"], r["_l"], r["n_words"]) == (1, 2, 2)


def test_quality_odd_rows(spark):
    out = quality.judge(odd(spark), [])
    rows = out.collect()
    assert len(rows) == odd(spark).count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    assert quality.judge(none(spark), []).count() == 0


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(VOCABULARY), packing.WordTokens(open(VOCABULARY, encoding="utf-8").read())
    rng = random.Random(4)
    bits = ["a", "the", ".", ",", "É", "é", "x̂.", " ", "\n", "\x0b", "\xa0", "'s", "don't", "1", "23", "<|endoftext|>", "<|", "ß", "Σ", "日本", "😀", "A", "İ", "ﬁ", "...", "a.,", "B,", "\x00", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    ids, first = fast(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert whole.encode(t, add_special_tokens=False).ids == ids[first[i] : first[i + 1]].tolist()


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_within_capacity(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 60, 500), rng.integers(100, 1001, 800), np.full(40, 1000), np.full(700, 333)])
    counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    bins: dict[int, list] = {}
    seen: dict[int, list] = {x: [] for x in counts}
    for x, a, b, first, each, offset in packing.plan(counts, 1000):
        for r in range(a, b):
            bins.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * x, x))
            seen[x].append(r)
    assert all(sorted(seen[x]) == list(range(counts[x])) for x in counts)
    for items in bins.values():
        at = 0
        for offset, x in sorted(items):
            assert offset == at
            at += x
        assert at <= 1000
    # against plain best fit of decreasing lengths
    rooms: list[int] = []
    for x in sorted(lengths.tolist(), reverse=True):
        k = min((k for k in range(len(rooms)) if rooms[k] >= x), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(1000 - x)
        else:
            rooms[k] -= x
    assert len(bins) == packing.bins_of(packing.plan(counts, 1000)) <= len(rooms)
    assert packing.plan({}, 1000) == []


@pytest.mark.parametrize(("low", "high", "grouped"), [(1300, 2900, False), (513, 4096, False), (700, 1500, True)])
def test_no_more_bins_than_best_fit_on_hard_lengths(low, high, grouped):
    counts = dict(Counter(np.random.default_rng(0).integers(low, high, 20_000).tolist()))
    best_fit = packing.bins_of(packing.grouped_plan(counts, 4096, 0))
    found = packing.bins_of(packing.plan(counts, 4096))
    assert found < best_fit if grouped else found <= best_fit


def test_plans_of_few_items_are_optimal():
    """Against the best of all ways to share out a handful of items."""

    def fewest(items, rooms):
        if not items:
            return len(rooms)
        out = 99
        for k in {r: k for k, r in enumerate(rooms) if r >= items[0]}.values():
            out = min(out, fewest(items[1:], [*rooms[:k], rooms[k] - items[0], *rooms[k + 1 :]]))
        return min(out, fewest(items[1:], [*rooms, 100 - items[0]]))

    rng, over = random.Random(3), 0
    for _ in range(40):
        items = sorted((rng.randint(5, 100) for _ in range(8)), reverse=True)
        found, want = packing.bins_of(packing.plan(dict(Counter(items)), 100)), fewest(items, [])
        assert want <= found <= want + 1
        over += found - want
    assert over <= 3


def test_places_are_read_without_python_workers(spark):
    places = packing.plan({4000: 3, 90: 50, 1: 7}, 4096)
    table = packing.table_of(spark, places)
    assert sorted(map(tuple, table.collect())) == sorted(places)
    assert table.columns == ["_length", "_from", "_to", "_bin", "_each", "_offset"]
    assert "Python" not in table._jdf.queryExecution().toRdd().toDebugString()
    assert packing.table_of(spark, []).count() == 0


def test_packing_odd_rows(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(VOCABULARY)
    docs = odd(spark)
    got = packing.pack(docs, VOCABULARY, 512).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r["doc_id"], k, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512])) for k, s in enumerate(range(0, len(ids), 512)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(none(spark), VOCABULARY, 512).count() == 0


def test_packed_sequences_hold_the_token_ids(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(VOCABULARY)
    docs = odd(spark)
    got = packing.pack(docs, VOCABULARY, 512).collect()
    want = Counter((r["doc_id"], tuple([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
    sequences: dict[int, np.ndarray] = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at = sequences.setdefault(r["sequence_id"], np.zeros(0, np.uint32))
        assert len(at) == r["offset"]
        sequences[r["sequence_id"]] = np.concatenate([at, ids])
    # every document read back from the sequences
    pieces: dict[tuple, list] = {}
    for r in got:
        part = sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        pieces.setdefault((r["doc_id"], r["start"]), []).append(tuple(part.tolist()))
    assert Counter(x for v in pieces.values() for p in v for x in p) == Counter(x for (_, ids), n in want.items() for x in ids * n)
    whole = Counter((doc, p) for (doc, start), v in pieces.items() if start == 0 for p in v)
    assert whole == Counter({k: n for k, n in Counter((doc, ids[:512]) for (doc, ids), n in want.items() for _ in range(n)).items()})


def test_a_worker_loads_its_tokenizer_once(spark):
    import public_tokenizers

    from reviewlens.llm.packing import WordTokens

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()

    def run(batches):
        import pyarrow as pa

        for _ in batches:
            one, two = WordTokens(spec), WordTokens(spec)
            same = one.full is two.full and one.quick is two.quick and one.known is not two.known
            yield pa.RecordBatch.from_arrays([pa.array([same])], ["same"])

    assert [r["same"] for r in spark.range(1).mapInArrow(run, "same boolean").collect()] == [True]
