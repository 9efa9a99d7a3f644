import numpy as np

from reviewlens.llm import media


def test_a_shifted_recording_has_the_shifted_fingerprint():
    x = media.tones(np.random.default_rng(1).normal(size=80))
    whole, cut = media.fingerprint(media.chroma(x, 4000)), media.fingerprint(media.chroma(x[7 * media.HOP :], 4000))
    n = len(cut) - 12  # the last filters reach past the end
    assert (whole[7 : 7 + n] == cut[:n]).all() and len(set(whole.tolist())) > 20
    assert len(media.fingerprint(media.chroma(x[:100], 4000))) == 0


def test_integral_image_boxes_equal_sums():
    image = np.random.default_rng(2).random((20, 12))
    kind, y, h, w = media.FILTERS[0]
    padded = np.pad(image, ((0, 20), (0, 0)), mode="edge")
    top = min(y + 2 * h, 12)
    want = [np.searchsorted(media.LEVELS, np.log((padded[i : i + w, y : y + h].sum() + 1e-3) / (padded[i : i + w, y + h : top].sum() + 1e-3))) for i in range(20)]
    assert ((media.fingerprint(image) >> np.uint64(30)) == media.GRAY[want]).all()


def test_alignment_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=90).tolist()
    rows = [(0, base[:70]), (1, base[20:]), (2, rng.normal(size=64).tolist()), (20, base[10:80]), (3, base[:70]), (40, None), (60, [0.1]), (None, base[:70])]
    prints = media.fingerprints(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", media.tones)
    got = {r["id"]: r for r in media.align(prints).collect()}
    p = {r["id"]: r["fingerprint"] for r in prints.collect() if r["id"] is not None}
    assert len(got) == len(rows) and got[3]["class_id"] == 0 and got[40]["frames"] == 0 and got[60]["match_id"] is None
    for q in (0, 20):
        best = None
        for k in (0, 1, 2, 20):
            if k != q:
                for off in range(-80, 81):
                    n = sum(0 <= i + off < len(p[k]) and p[q][i] == p[k][i + off] for i in range(len(p[q])))
                    if n and (best is None or (-n, k, abs(off), off) < best):
                        best = (-n, k, abs(off), off)
        assert (got[q]["match_id"], got[q]["offset"]) == (best[1], best[3])
        pairs = [(p[q][i], p[best[1]][i + best[3]]) for i in range(len(p[q])) if 0 <= i + best[3] < len(p[best[1]])]
        want = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in pairs) / (32 * len(pairs))
        assert abs(got[q]["bit_error"] - want) < 1e-12
    assert media.align(prints.limit(0)).count() == 0


def test_every_alignment_is_reported(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=120).tolist()
    rows = [(20, base), (1, base[:60]), (2, base[30:100]), (3, base[70:]), (4, base[:60]), (5, rng.normal(size=64).tolist())]
    prints = media.fingerprints(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", media.tones)
    got = {r["id"]: r for r in media.align(prints).collect()}
    p = {r["id"]: r["fingerprint"] for r in prints.collect()}
    want = {}
    for k in (1, 2, 3, 5):
        counts = [(-sum(0 <= i + off < len(p[k]) and p[20][i] == p[k][i + off] for i in range(len(p[20]))), abs(off), off) for off in range(-130, 131)]
        n, _, off = min(counts)
        pairs = [(x, p[k][i + off]) for i, x in enumerate(p[20]) if 0 <= i + off < len(p[k])]
        error = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in pairs) / (32 * len(pairs))
        if -n >= media.VOTES and error <= media.BIT_ERROR:
            want[k] = (off, -n, round(error, 9))
    assert set(want) >= {1, 2, 3}
    found = got[20]["matches"]
    assert len(found) == len(want) and {m["match_id"]: (m["offset"], m["votes"], round(m["bit_error"], 9)) for m in found} == want
    assert [m["bit_error"] for m in found] == sorted(m["bit_error"] for m in found) and got[1]["matches"] is None


def test_a_frame_that_all_recordings_share_is_counted_in_bounded_parts(spark, monkeypatch):
    """Silence gives one integer for every frame: each pair of recordings has all pairs of its frames."""
    silent = [(k, [0.0] * (40 + k)) for k in range(0, 60, 3)]
    prints = media.fingerprints(spark.createDataFrame(silent, "vec_id long, embedding array<double>"), "vec_id", "embedding", media.tones)
    whole = {r["id"]: r for r in media.align(prints).collect()}
    monkeypatch.setattr(media, "PAIRS", 50)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 60)
    parts = {r["id"]: r for r in media.align(prints).collect()}
    assert whole == parts and set(whole) == {k for k, _ in silent}
    assert len(whole[0]["matches"]) == len(silent) - 1 and whole[0]["match_id"] == 3 and whole[0]["offset"] == 0


def test_odd_recordings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(20, [inf, nan, -inf, None] * 20, 1), (20, [inf, nan, -inf, None] * 20, 1), (1, [1.0, 0.0, -1.0, 0.0] * 20, 2), (2, [], 3), (3, None, 4), (None, [1.0, 0.0, -1.0, 0.0] * 20, 5)]
    prints = media.fingerprints(spark.createDataFrame(rows, "vec_id long, embedding array<double>, frames int"), "vec_id", "embedding", media.tones)
    got = media.align(prints).collect()
    assert len(got) == len(rows) and [r["class_id"] for r in got if r["frames"]] == [1] * 4
    assert all(r["matches"] == [] for r in got if r["id"] == 20) and all(r["matches"] is None for r in got if r["id"] != 20)


def test_prints_do_not_depend_on_what_stands_beside(spark):
    rng = np.random.default_rng(9)
    xs = [media.tones(rng.normal(0, 0.15, n)) for n in (64, 70, 64, 64, 5, 64, 700)]
    for x, p in zip(xs, media.prints_of(xs, 4000), strict=True):
        assert (media.prints_of([x], 4000)[0] == p).all()
