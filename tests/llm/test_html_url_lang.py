import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import bloom, html_text, language, url_filter
from reviewlens.llm.common import gathered, text_buffers

from .helpers import none, odd


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(800):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = sorted(html_text.common_lines(a, b))
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(any(y == a[i] for y in rest) for i in got)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<p>a  b\n c</p><p>d</p>", "a b c d"),
        ("<head><title>t</title></head><body><article><h1>T</h1><p>x<b>y</b> &amp; &#233;&copy<br>z</article><footer>f</footer>", "T xy & é© z"),
        ("<nav><ul><li><a href='/a'>A</a></li></ul></nav><main><p>m</p></main><aside>s</aside>", "m"),
        ("<article><p>a</p><div class='ad'>buy<div>more</div></div><p>b</p><section id='comments'><article>c</article></section></article>", "a b"),
        ("<article><p>a</p><form><input value='x'>f</form><script>if (a < b) { '</p>' }</script><style>p{}</style><p>b &lt;i&gt;</p>", "a b <i>"),
        ("<div class='cookie-notice'>c<article><p>a</p></article>", "a"),
        ("<article><p>cut in a tag <a href=", "cut in a tag"),
        ("<article><p>1 < 2 and <!-- gone --> 3</p></article>", "1 < 2 and 3"),
    ],
)
def test_lines_and_zones(page, want):
    assert html_text.main_text(html_text.lines_of(page), None) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><div class='share-price'><p>figures</p></div><div class=\"share-buttons\">f t</div></article>", "figures"),
        ('<article><p>a</p><div class="related work"><p>b</p></div><div class="ad box">c</div><div data-id="share">d</div></article>', "a b d"),
        ("<a title=don't>x</a><p>b's</p> <p>c</p>", "x b's c"),
        ("<p class=it's>a</p><p>b</p>", "a b"),
        ('<p title="open>a</p><p>b</p>', "a b"),
        ('<p title="a > b">c</p>', "c"),
        ("<article><p>a</p><p title='x>y' class=ad>b</p></article>", "a"),
    ],
)
def test_quotes_and_names_inside_an_article(page, want):
    assert html_text.main_text(html_text.lines_of(page), None) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><meta charset=utf-8><body><p>a</p>", "a"),
        ("<head><title>t</title><p>a</p>", "a"),
        ("<head><script>x</script> text that ends it", "text that ends it"),
        ("<head><title>t</title><noscript>n</noscript></head><p>a", "a"),
        ("<p>foo<img src=x>bar and wor<nobr>d</nobr></p>", "foobar and word"),
        ("<p><ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>c <my-part>d</my-part>e <input>f</p>", "a(b)c de f"),
        ("<p>one<script>x</script>two<br>three</p>four<div>five</div>six", "onetwo three four five six"),
        ('<article><div class="widget-content"><p>main text</p></div></article>', "main text"),
        ('<article><div class="reply"><p>Dear reader</p></div></article>', "Dear reader"),
        ('<article><p>a</p><div class="reply"><p>b</p></div></article>', "a"),
        ('<article><div class="comments"><p>first!</p></div></article>', ""),
        ('<main><p>a</p><div class="advertisement-x-y">buy</div></main>', "a"),
        ('<article><p>a<span class="ad">b</span>c</p></article>', "a c"),
    ],
)
def test_omitted_tags_and_elements_inside_a_line(page, want):
    assert html_text.main_text(html_text.lines_of(page), None) == want


def test_a_long_frame_makes_no_near_copies(spark):
    frame = "".join(f"<p>{' '.join(f'f{j}' for j in range(k, k + 30))}</p>" for k in range(0, 300, 30))
    rows = [(k, f"http://h/a/{k}", f"<body>{frame}<p>story {k} of {k * 7} things</p></body>") for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"story {k} of {k * 7} things" for k in range(6)}


def test_the_difference_decides_where_no_marks_do(spark):
    shared = "<p>About us</p><p>All rights reserved</p>"
    rows = [(k, f"http://h.com/a/{k}", f"<body>{shared}<p>own words {k} {' '.join(f'x{k}y{j}' for j in range(20))}</p></body>", 5) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text int")
    with_mates = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    alone = {k: html_text.main_text(html_text.lines_of(h), None) for k, _, h, _ in rows}
    assert all(alone[k].startswith("About us") and with_mates[k].startswith(f"own words {k}") for k in alone)
    for n in (1, 8, 40):
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages.repartition(n)).collect()} == with_mates


def test_differencing_deletes_what_neighbours_share(spark):
    page = lambda x: f"<div>Site name</div><p>{x}</p><div>Imprint</div>"
    rows = [(1, "http://h/a/1", page("one")), (2, "http://h/a/2", page("two")), (3, "http://other/x", page("alone")), (4, None, None), (5, "http://h/a/3", "")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1]["text"] == "one" and got[2]["text"] == "two"
    assert got[3]["text"] == "Site name alone Imprint"
    assert got[4]["text"] == "" and got[4]["n_chars"] == 0 and got[5]["text"] == ""


def test_pages_with_an_article_are_differenced(spark, monkeypatch):
    """Each loses the parts and lines that its neighbour has too, and no line of its article."""
    seen, held = spark.sparkContext.accumulator(0), html_text._held

    def watched(lines, runs):
        left = [x for i, of in enumerate(html_text._keys(lines)[1]) if i not in runs for x in of]
        assert [lines[k][0] for k in left] == ["article", "article"], (lines, runs)
        seen.add(1)
        return held(lines, runs)

    monkeypatch.setattr(html_text, "_held", watched)
    page = "<nav>menu {0}</nav><p>Site name</p><article><p>same line</p><p>own {0}</p></article><p>Imprint</p><footer>f</footer>"
    rows = [(k, f"http://h/{k}", page.format(k)) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"same line own {k}" for k in range(6)} and seen.value == 6


def test_an_article_in_a_named_part_stays_beside_its_like(spark):
    page = "<nav>menu</nav><article><div class='reply'><p>Dear reader {}</p></div></article>"
    rows = [(k, f"http://h/{k}", page.format(k)) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Dear reader {k}" for k in range(4)}


def test_equal_articles_on_neighbours_stay(spark):
    page = "<nav>menu</nav><article><p>same text</p></article>"
    rows = [(k, f"http://h/{k % 3}", page) for k in range(9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 9 and all(r["text"] == "same text" and r["n_chars"] == 9 for r in got)


PAGE = "<div>Site name</div><p>{}</p><p>{}</p><div>Imprint</div>"
LONG = " ".join(f"w{k}" for k in range(80))


def test_unmarked_copies_keep_their_text(spark):
    copies = [(k, f"http://h/a/{k:02}", PAGE.format("same story", LONG)) for k in range(30)]
    near = [(30 + k, f"http://h/b/{k:02}", PAGE.format(f"near story {k}", LONG[::-1])) for k in range(30)]
    alone = [(60 + k, f"http://alone/{k}", PAGE.format("same story", LONG)) for k in range(3)]
    rows = [*copies, *near, *alone, (70, "http://h/c", PAGE.format("another", "thing"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == f"same story {LONG}" for k in range(30))
    assert all(got[30 + k] == f"near story {k} {LONG[::-1]}" for k in range(30))
    assert all(got[60 + k] == f"Site name same story {LONG} Imprint" for k in range(3)) and got[70] == "another thing"


def test_mates_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(k, f"http://h{rng.randrange(9)}/{rng.randrange(20)}", PAGE.format(f"story {k if rng.random() < 0.6 else 0}", f"text {k % 7}")) for k in range(150)]
    pages = spark.createDataFrame([*rows, (150, "http://two/1", PAGE.format("a", "b")), (151, "http://two/2", PAGE.format("c", "d"))], "page_id long, url string, html string")
    seen, old = [], {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            seen.append({r["page_id"]: r["text"] for r in html_text.extract(pages).collect()})
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert seen[0] == seen[1] and seen[1][150] == "a b" and seen[1][151] == "c d"


def test_html_odd_rows(spark):
    rows = [(None, None, None, "a", 1), (1, "x", "<p>" + "long " * 200_000, "b", 2), (1, "x", "<p>" + "long " * 200_000, "b", 2), (2, "http://h", "<" * 50, None, None)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, _row string, _host int"))
    got = out.collect()
    assert len(got) == 4 and "_host" in out.columns and max(r["n_chars"] for r in got) == 5 * 200_000 - 1
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


URLS = ["http://A.example.com/en/7x", "https://a.example.com/en/6", "http://example.net/de/8?x#y", "ftp://b.example.net/de/1", "http://x.org/es/", "http://xorg/es/", "no scheme", "", None, "http://h?q=/", "http://H#f", "a://b://c/d"]
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end], rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(a, h, p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, 1, "w", "r", "m") for k, u in enumerate(URLS)], "page_id long, url string, block int, w0 string, listed string, canonical string")
    out = url_filter.filter_urls(pages, RULES, spark.createDataFrame([("h",)], "c string"))
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == len(URLS) and {(r["block"], r["w0"], r["listed"], r["canonical"]) for r in got} == {(1, "w", "r", "m")}
    for r in got:
        host, path, rule, verdict = judge(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if host == "h" and "?" not in URLS[r["page_id"]] else "allow"))


def test_canonical(spark):
    rows = [("http://www.A.com/x/?utm_source=f&b=2&a=1&ref=q#z", "a.com/x?a=1&b=2"), ("https://a.com/x", "a.com/x"), ("https://a.com/x/?ref=x", "a.com/x"), ("https://a.com/?refer=1", "a.com?refer=1")]
    got = spark.createDataFrame(rows, "u string, want string").withColumn("got", url_filter.canonical(F.col("u"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_bloom_never_misses_and_list_is_exact(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") * 2).alias("c"))
    pages = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("canonical"), F.lit(1).alias("block"))
    out = url_filter.listed_among(pages.unionByName(pages.limit(5)).unionByName(spark.createDataFrame([(None, 1)], "canonical string, block int")), listed.union(listed))
    got = out.collect()
    assert len(got) == 6006 and sum(r["listed"] for r in got if r["canonical"]) >= 3000
    assert all(r["listed"] == (r["canonical"] is not None and int(r["canonical"][1:]) % 2 == 0) for r in got)
    clear, maybe = bloom.split(pages, "canonical", listed)
    assert clear.where("int(substr(canonical, 2)) % 2 = 0").count() == 0 and maybe.count() < 3300
    assert url_filter.listed_among(pages, listed.limit(0)).where("listed").count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES, listed).count() == 0


def test_backpropagation_through_time_matches_differences():
    rng = np.random.default_rng(0)
    net = language.fit([b"abc abd", b"xyz xyw"], ["a", "b"], hidden=3, rounds=1, batch=4)
    for name in "eubvc":
        setattr(net, name, getattr(net, name).astype(np.float64))
    seq, mask, goal = rng.integers(97, 123, (5, 4)).astype(np.uint8), np.ones((5, 4)), np.array([0, 1, 1, 0])
    _, grads = language._learn_step(net, seq, mask, goal)
    for name in "ubvc":
        x = getattr(net, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in x.shape)
            keep, eps = x[at], 1e-3
            x[at] = keep + eps
            up = language._learn_step(net, seq, mask, goal)[0]
            x[at] = keep - eps
            down = language._learn_step(net, seq, mask, goal)[0]
            x[at] = keep
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-3)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    net = language.learn(docs)
    out = language.predict(docs, net).withColumn("held", language.held_out(F.col("doc_id"))).toPandas()
    held = out[out.held]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_batches_are_gathered():
    texts = [["ab", None], [], ["c" * 9], ["d", "e"], ["f" * 30], ["g"]]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in texts]
    got = [b.column(0).to_pylist() for b in gathered(iter(batches), "text", 11)]
    assert got == [["ab", None, "c" * 9], ["d", "e"], ["f" * 30], ["g"]]
    assert [b.column(0).to_pylist() for b in gathered((batches[i].slice(1) for i in (0, 3)), "text", 100)] == [[None, "e"]]


def test_language_odd_rows(spark):
    docs = odd(spark)
    net = language.learn(docs)
    got = language.predict(docs, net).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert r["lang_pred"] in ("und", "en", "de") and 0 <= r["score"] <= 1
    assert language.learn(none(spark)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(none(spark), net).count() == 0


def test_whole_texts_are_pooled():
    net = language.fit([b"aaaa bbbb", b"zzzz yyyy"], ["a", "z"], rounds=60)
    p = language.pooled(net, *text_buffers(pa.array(["aaaa " * 50 + "zzzz " * 5000, "aaaa", "", None])))
    assert p[0].argmax() == 1 and p[1].argmax() == 0 and p[0].sum() == pytest.approx(1, abs=1e-5) and p[2].sum() == 0


def position_by_position(net, t):
    """The pooled probabilities of one text, each direction's state carried from end to end."""
    net, seq, n = language.exact(net), np.frombuffer(t, np.uint8), net.b.shape[1]
    one, states = np.float32(1), []
    for way in (0, 1):
        h, out = np.zeros(n, np.float32), np.zeros((len(seq), n), np.float32)
        for i in range(len(seq)) if way == 0 else range(len(seq) - 1, -1, -1):
            x, y = net.e[way][seq[i]], h @ net.u[way]
            g = np.clip(x[: 2 * n] + y[: 2 * n], 0, language.GATE)
            k = np.clip((y[2 * n :] + net.b[way]) * g[n:] + x[2 * n :], -one, one)
            h = (np.rint((k + g[:n] * (h - k)) * np.float32(1024)) / np.float32(1024)).astype(np.float32)
            out[i] = h
        states.append(out)
    x = (np.concatenate(states, axis=1) @ net.v + net.c).astype(float)
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return (x / x.sum(axis=1, keepdims=True)).mean(axis=0)


def test_states_go_through_the_whole_text():
    """Against the network read position by position, for lengths on either side of the runs' ends."""
    rng = np.random.default_rng(2)
    pool = {"a": b"the cat sat on a mat and ", "z": b"der hund lag auf dem bett "}
    net = language.fit(list(pool.values()), list(pool), rounds=120)
    sizes = (1, 63, 64, 65, 333, 2047, 2048, 2049, 2112, 9000)
    texts = [(pool[x] * 400)[:m] for m in sizes for x in "az"] + [bytes(rng.integers(97, 122, m).astype(np.uint8)) for m in sizes]
    got = language.pooled(net, *text_buffers(pa.array([t.decode() for t in texts])))
    for t, p in zip(texts, got, strict=True):
        assert np.abs(position_by_position(net, t) - p).max() < 1e-5
    # what is read together changes nothing
    for i in (5, 13, 19, 29):
        assert np.abs(language.pooled(net, *text_buffers(pa.array([texts[i].decode()])))[0] - got[i]).max() < 1e-6


def test_a_network_that_never_forgets_is_read_on_from_end_to_end(monkeypatch):
    monkeypatch.setattr(language, "GATE", np.float32(1))
    net = language.fit([b"abab", b"cdcd"], ["a", "c"], hidden=4, rounds=30)
    # every gate keeps the state, but for one byte that sets it
    n = 4
    net.u[:] = 0
    net.e[:, :, :n] = 9
    net.e[:, ord("!"), :n] = -9
    net.e[:, :, 2 * n :] = np.linspace(-0.7, 0.7, 256, dtype=np.float32)[None, :, None]
    net.e[:, ord("!"), 2 * n :] = 0.25
    text = b"b" * 700 + b"!" + b"c" * 4000
    got = language.pooled(net, *text_buffers(pa.array([text.decode(), "b" * 4701])))
    assert np.abs(position_by_position(net, text) - got[0]).max() < 1e-5
    assert np.abs(got[0] - got[1]).max() > 1e-4


def test_every_label_is_learned(spark):
    docs = spark.range(2100).selectExpr("id as doc_id", "concat('w', repeat(chr(97 + id % 20), 5), ' ', repeat(chr(97 + cast(id % 70 / 20 as int)), 9)) as text", "concat('l', id % 70) as lang")
    net = language.learn(docs)
    assert len(net.labels) == 70
    rare = docs.unionByName(spark.createDataFrame([(99_999_999 + k, "q q q", "rare") for k in range(2)], docs.schema))
    assert "rare" in language.learn(rare).labels


def test_rows_of_one_key_push_no_label_out(spark):
    rows = [(1, "ab ba abba", "aa")] * 4000 + [(2, "zyz yzz", "zz"), (3, "zzy", "zz")]
    rows = [(k, t, l) for k, t, l in rows for k in [next(x for x in range(k * 100, k * 100 + 99) if zlib.crc32(str(x).encode()) % 5)]]
    net = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.labels == ["aa", "zz"]
