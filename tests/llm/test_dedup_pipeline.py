from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from reviewlens.llm import common as common_module
from reviewlens.llm import ngram_join, substrings
from reviewlens.llm.common import window_hashes, word_hashes, word_spans, text_buffers

from .helpers import LOWER, components, none, odd, odd_rows, removed, repeats, words


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["a b  c", None, "", "\n x", "a\tb", "averyverylongword averyverylongwore", "Ünï naïve. 日本語"] * 2
    raw, at = text_buffers(pa.array(texts).slice(1))
    start, end, first = word_spans(raw, at)
    data = raw.tobytes()
    got = [[data[start[k] : end[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts) - 1)]
    assert got == [words(t) for t in texts[1:]]
    h = word_hashes(raw, start, end)
    by = {}
    for k in range(len(start)):
        assert by.setdefault(data[start[k] : end[k]], h[k]) == h[k]
    assert len(set(by.values())) == len(by)
    assert len(window_hashes(h, 3)) == len(h) - 2 and len(window_hashes(h[:2], 3)) == 0


@pytest.mark.parametrize("size, per", [(4, 85), (5, 80), (2, 50)])
def test_components_match_brute_force(spark, size, per):
    rows = [(r[0], r[1]) for r in odd_rows(seed=size, n=120) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    n, root = components([t for _, t in rows], size, per)
    want = Counter()
    for i, (key, _) in enumerate(rows):
        own = min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) if n[i] else key
        want[(key, n[i], own)] += 1
    got = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs, size, per).collect())
    assert got == want


def test_meeting_counts_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 120).astype(np.uint64)
    sets = []
    for _ in range(60):
        x = base.copy()
        at = rng.integers(0, 120, rng.integers(0, 14))
        x[at] = rng.integers(0, 1 << 40, len(at)).astype(np.uint64)
        sets.append(np.unique(x))

    def parts(links, n):
        up = list(range(n))
        for a, b in links:
            ra, rb = up[a], up[b]
            up = [min(ra, rb) if u in (ra, rb) else u for u in up]
        return up

    good = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert parts(ngram_join.meet(sets, [0] * 60, 85), 60) == parts(good, 60)
    sides = [0] * 25 + [1] * 35
    across = [(i, j) for i, j in good if sides[i] != sides[j]]
    assert parts(ngram_join.meet(sets, sides, 85), 60) == parts(across, 60)


def test_blocks_of_a_large_home_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(ngram_join, "SETS_A_PART", 20)
    monkeypatch.setattr(ngram_join, "HEAVY", 1 / 50)
    test_components_match_brute_force(spark, 4, 85)


def test_join_stores_no_shingles(spark, monkeypatch):
    """What the join writes down takes less than its texts, where all shingles would take more."""
    import pathlib

    stored, write = [], ngram_join.Scratch.write

    def weighed(self, df, name):
        out = write(self, df, name)
        at = pathlib.Path(self.root.removeprefix("file:").replace("//", "/")) / name
        stored.append(sum(f.stat().st_size for f in at.rglob("*.parquet")))
        return out

    monkeypatch.setattr(ngram_join.Scratch, "write", weighed)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 1000)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.link(docs, 4, 85).collect()
    assert sorted((r["id"], r["n_shingles"]) for r in got) == [(k, 997) for k in range(200)]
    assert sum(stored) < 200 * 997 * 8 / 2


def test_a_task_of_the_join_holds_one_worker(spark, monkeypatch):
    """No step in Python reads another one's rows within its task, where each would hold a worker of its own."""
    fed, step = [], ngram_join.in_python

    def watched(df, run, schema):
        fed.append(str(df._jdf.queryExecution().optimizedPlan().toString()))
        return step(df, run, schema)

    monkeypatch.setattr(ngram_join, "in_python", watched)
    assert ngram_join.link(odd(spark), 4, 85).count()
    assert len(fed) >= 5
    for plan in fed:
        assert "MapInArrow" not in plan.partition("RepartitionByExpression")[0]


def test_join_odd_rows(spark):
    docs = odd(spark)
    got = ngram_join.link(docs, 4, 85).collect()
    assert len(got) == docs.count()
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["id"] for r in got if r["group"] is None)
    assert ngram_join.link(none(spark)).count() == 0
    kept = ngram_join.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    groups = {}
    for r in got:
        groups.setdefault(r["group"], []).append(r)
    assert kept.count() == len(groups) - 1 + len(groups[None])
    assert ngram_join.keep_one(none(spark)).count() == 0


def counted_pairs(spark, monkeypatch, rows, size, per):
    """The components of ``rows``, and how many pairs of classes their lists gave."""
    seen, made = spark.sparkContext.accumulator(0), ngram_join._home_pairs

    def watched(per):
        def run(batches):
            for batch in made(per)(batches):
                seen.add(batch.num_rows)
                yield batch

        return run

    with monkeypatch.context() as m:
        m.setattr(ngram_join, "_home_pairs", watched)
        m.setattr(ngram_join, "HEAVY", 1)
        got = {r["id"]: r["component_id"] for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, per).collect()}
    return got, seen.value


@pytest.mark.parametrize("words", [60, 300, 2500])
def test_sets_that_share_a_passage_make_no_pairs(spark, monkeypatch, words):
    rng = np.random.default_rng(words)
    passage = " ".join(f"p{x}" for x in range(min(55, words // 3)))
    rows = [(k, f"{' '.join(f'w{x}' for x in rng.integers(0, 1 << 30, words))} {passage}") for k in range(120)]
    got, pairs = counted_pairs(spark, monkeypatch, rows, 4, 85)
    assert got == {k: k for k in range(120)} and pairs <= 120


def test_links_between_single_homes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHANCE", 1 << 40)
    test_components_match_brute_force(spark, 4, 85)
    test_components_match_brute_force(spark, 2, 50)


@pytest.mark.parametrize("words", [40, 250])
def test_links_between_homes_stay(spark, monkeypatch, words):
    """Chains, each text a little changed from the one before, all with one passage: their links lie between homes."""
    rng = np.random.default_rng(words)
    texts = []
    for chain in range(4):
        own = [f"c{chain}w{k}" for k in range(words)]
        for k in range(25):
            for at in rng.integers(0, words, max(1, words // 100)):
                own[at] = f"c{chain}v{k}x{at}"
            texts.append(" ".join(own) + " the same passage stands at the end of every text of all of these chains")
    rng.shuffle(texts)
    n, root = components(texts, 4, 85)
    monkeypatch.setattr(ngram_join, "CHANCE", 1 << 40)
    got, pairs = counted_pairs(spark, monkeypatch, list(enumerate(texts)), 4, 85)
    assert got == {k: min(j for j in range(len(texts)) if root[j] == root[k]) for k in range(len(texts))}
    assert pairs and len(set(got.values())) < len(texts)


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 90)).astype(np.uint64)) for _ in range(40)]
    sets[3] = sets[7] = np.zeros(0, np.uint64)
    sketch = np.stack(ngram_join.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])), axis=1)
    sets = [x for x in sets if len(x)]
    assert len(sketch) == len(sets)
    for a, x in zip(sets, sketch, strict=True):
        for b, y in zip(sets, sketch, strict=True):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[102] == 100


@pytest.mark.parametrize("size", [20, 8])
def test_removed_words_match_brute_force(spark, size):
    rows = [(r[0], r[1]) for r in odd_rows(seed=7 + size, n=120)][:-3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.deduplicate(docs, size).collect())
    assert got == Counter(removed(rows, size))


def test_small_blocks_give_the_same(spark, monkeypatch):
    import reviewlens.llm.substrings as s

    monkeypatch.setattr(s, "slices", lambda batch, column: (batch.slice(i, 1) for i in range(batch.num_rows)))
    test_removed_words_match_brute_force(spark, 20)


def test_substrings_odd_rows(spark):
    docs = odd(spark)
    out = substrings.deduplicate(docs, 20)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()) == Counter(removed(rows, 20))
    assert substrings.deduplicate(none(spark), 20).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    frames = [docs]
    for name, stage in cp.STAGES:
        stage(spark, frames[-1], d).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    _, good, one, cut, mixed, packed = [f.collect() for f in frames]
    assert frames[1].columns == frames[4].columns == cp.COLUMNS
    for r in good:
        assert len(words(r["text"])) >= 10
    n, root = components([r["text"] for r in good], 5, 80)
    assert sorted(r["doc_id"] for r in one) == sorted(min(good[j]["doc_id"] for j in range(len(good)) if root[j] == k) for k in set(root))
    want = {key: (gone, kept) for key, _, gone, kept in removed([(r["doc_id"], r["text"]) for r in one], 20)}
    whole = {r["doc_id"]: r["text"] for r in one}
    for r in cut:
        gone, kept = want[r["doc_id"]]
        assert r["text"] == (kept if gone else whole[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    times = Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in cut}
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times
    assert cp.run(spark, d).count() == len(packed)


def test_pipeline_stages_odd_rows(spark, tmp_path):
    """Each stage by itself on difficult rows with extra columns, and on none at all."""
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in odd_rows()]
    got = {}
    for name, stage in cp.STAGES:
        out = stage(spark, odd(spark), str(tmp_path))
        if name != cp.STAGES[-1][0]:
            assert out.columns == cp.COLUMNS
        got[name] = [tuple(r) for r in out.collect()]
        assert stage(spark, none(spark), str(tmp_path)).count() == 0
    passed = [r for r in rows if len(words(r[1])) >= 10 and 100 * repeats(words(r[1])) <= 20 * len(words(r[1]))]
    assert Counter(got["quality_rules"]) == Counter(passed)
    _, root = components([r[1] for r in rows], 5, 80)
    least = {}
    for r, k in zip(rows, root, strict=True):
        least[k] = min(least.get(k, 1 << 63), 1 << 63 if r[0] is None else r[0])
    assert Counter(1 << 63 if r[0] is None else r[0] for r in got["near_duplicates"]) == Counter(least.values())
    left = Counter((k, kept if gone else r[1]) for r, (k, _, gone, kept) in zip(rows, removed([r[:2] for r in rows], 20), strict=True))
    assert Counter(r[:2] for r in got["substring_dedup"]) == left
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in got["substring_dedup"])
    often, copies = Counter(rows), Counter(got["source_mix"])
    assert copies and all(copies[r] <= 2 * often[r] for r in copies)
    assert {r[0] for r in got["best_fit_packing"]} == {r[0] for r in rows}


def test_lower_case_is_ascii_only(spark):
    docs = spark.createDataFrame([(1, "The Quick brown FOX É"), (2, "the quick BROWN fox É"), (3, "the quick brown fox é")], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in ngram_join.link(docs, 5, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and "É".translate(LOWER) == "É"


def test_a_block_is_parsed_into_factors():
    """Factors are the longest that their places allow, each window that starts earlier lies in one, and with the words between them they are the text."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(12)]
    passage = [vocabulary[k] for k in rng.integers(0, 12, 40)]
    texts = []
    for k in range(40):
        w = [vocabulary[j] for j in rng.integers(0, 12, rng.integers(0, 90))]
        if k % 3 == 0:
            w = w[:20] + passage[int(rng.integers(0, 15)) :] + w[20:]
        if k % 7 == 0:
            w = ["a", "b"] * 30
        texts.append(" ".join(w))
    window = 8
    s, doc, whole, _, _, first, h = substrings._windows(*text_buffers(pa.array(texts)), window)
    later, _, source = substrings._later(whole, doc, s - first[doc])
    begin, size, copy = substrings.factors(h, first, s[later], s[source[later]], window)
    flat = [x for t in texts for x in t.split()]
    ends = np.repeat(first[1:], np.diff(first))
    covered = set()
    for a, n, b in zip(begin.tolist(), size.tolist(), copy.tolist(), strict=True):
        assert n >= window and b < a and flat[a : a + n] == flat[b : b + n] and a + n <= ends[a] and b + n <= ends[b]
        assert a + n == ends[a] or b + n == ends[b] or flat[a + n] != flat[b + n]
        covered.update(range(a, a + n - window + 1))
    seen, want = set(), set()
    for k in s.tolist():
        t = tuple(flat[k : k + window])
        if t in seen:
            want.add(k)
        seen.add(t)
    assert covered == want and len(begin) < len(want)
    for d, t in enumerate(texts):
        at, words_ = int(first[d]), []
        for a, n in sorted((int(a), int(n)) for a, n in zip(begin, size, strict=True) if first[d] <= a < first[d + 1]):
            words_ += flat[at:a] if a > at else []
            words_ += flat[max(a, at) : a + n]
            at = a + n
        assert words_ + flat[at : int(first[d + 1])] == t.split()


def test_streams_of_sorted_rows_carry_on_between_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 60, 200))
    doc, pos = rng.integers(0, 5, 200), rng.integers(0, 5, 200).astype(np.int32)
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    rk = pa.array(np.arange(200), mask=rng.random(200) < 0.3)
    table = pa.table({"h": h, "doc_id": doc, "rk": rk, "pos": pos})
    many = {x for x, n in Counter(h.tolist()).items() if n > 1}
    want = [(r, x) for r, x in zip(rk.to_pylist(), h.tolist(), strict=True) if r is not None and x in many]
    firsts = {}
    for x, d, p in zip(h.tolist(), doc.tolist(), pos.tolist(), strict=True):
        firsts[x] = min(firsts.get(x, (9, 9)), (d, p))
    late = [(d, p) for x, d, p in zip(h.tolist(), doc.tolist(), pos.tolist(), strict=True) if (d, p) > firsts[x]]
    for size in (1, 3, 200):
        got = [(r["rk"], r["h"]) for b in substrings._shared(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)
        got = [(r["doc_id"], r["pos"]) for b in substrings._resolve(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert sorted(got) == sorted(late)


def test_fewest_bounds_what_linked_sets_share_of_their_prefixes():
    rng = np.random.default_rng(5)
    for per in (20, 50, 80, 85, 100):
        for _ in range(400):
            a, b = sorted(rng.integers(1, 400, 2).tolist())
            need = ngram_join._need(a, b, per)
            if need > a:
                continue
            # the hardest case: what one set has alone comes first in the order
            both = rng.permutation(10_000)[:need] + (20_000 if rng.random() < 0.5 else 0)
            one, two = np.sort(np.append(both, 10_000 + np.arange(a - need))), np.sort(np.append(both, 15_000 - np.arange(b - need)))
            prefix = lambda x: x[: min(len(x), len(x) - -(-per * len(x) // 100) + ngram_join._more(len(x)))]
            shared = len(np.intersect1d(prefix(one), prefix(two)))
            assert shared >= ngram_join._fewest(a, a, b, b, per)
            assert shared >= ngram_join._fewest(a - 3, a + 9, b - 1, b + 50, per)


def test_homes_that_share_passages_hardly_meet(spark, monkeypatch):
    path = Path("/root/testdata/check_s/documents.parquet")
    if not path.exists():
        pytest.skip("needs the table check_s")
    shipped = []
    write = common_module.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "guests":
            shipped.append((out.count(), out.select("sid").distinct().count()))
        return out

    monkeypatch.setattr(common_module.Scratch, "write", counted)
    ngram_join.link(spark.read.parquet(str(path)), 5, 80)
    ((times, sets),) = shipped
    # a set in a home goes to one meeting; 253 of 8 056 went to more while homes met whole
    assert times - sets < 100, shipped
