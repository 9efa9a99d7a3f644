"""Main text of web pages by nearest-URL page differencing."""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import in_python, keep
from reviewlens.llm.ngram_join import link
from reviewlens.llm.url_filter import host_of, path_of

# Elements that never hold an article's text, elements that break a line, and void elements.
CHROME = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea object canvas dialog menu".split())
BREAKS = frozenset(
    "address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li listing main menu nav noscript object ol optgroup option p plaintext pre search section select summary svg table tbody td textarea tfoot th thead title tr ul xmp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of a class, an id or a role that name a part of the page beside its article.
PARTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words that only say what kind of box such a part is.
BOXES = frozenset("area bar block body box button buttons container content form group holder icons inner item items large left links list panel right row section slot small text title top bottom unit wrap wrapper".split())

# Words that name such a part wherever a class, id or role begins with them, and parts that never hold the article.
ALWAYS = frozenset("ads advert adverts advertisement cookie cookies disqus gdpr sponsored".split())
READERS = frozenset("comment comments disqus replies respond".split())
# All that may stand in a page's head.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|=)*)(?P<end>>|\Z)|(?P<text>[^<]+|<)", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "textarea", "title")}


def _is_part(tag: str, rest: str, in_article: bool) -> bool:
    """Whether an element stands beside the article: by its kind, or by a word of its class, id or role.

    Inside an article all words of a class, id or role must name such a part or its box: ``share-price``
    and ``related work`` are the article's own, ``share-buttons`` and ``ad box`` are not.
    """
    if tag in CHROME or (tag == "header" and not in_article):
        return True
    if not rest or tag in ("article", "main", "body", "html"):
        return False
    for m in _NAMES.finditer(rest):
        words = [w for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()) if w]
        if any(w in PARTS for w in words) and (not in_article or words[0] in ALWAYS or all(w in PARTS or w in BOXES or w.isdigit() for w in words)):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, str]]:
    """A page's lines: (zone, text). Zone ``article``, ``page``, or the name of the part beside the article.

    A part that an article holds, and that only its class, id or role names, has ``in`` before its name.
    A line is the text of a block, its character references decoded and its white space single; all
    elements but ``BREAKS`` stand inside a line. A head left open ends with the first element or text
    that can't stand in it. A quote counts only where an attribute's value begins with it, and only if
    another closes it.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []
    parts: list[list] = []  # open parts: tag, depth of that tag inside, name
    article = 0
    at, end = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((parts[0][2] if parts else "article" if article else "page", text))
            held.clear()

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            if parts and parts[-1][0] == "head" and not m["text"].isspace():
                flush()
                parts.clear()
            held.append(m["text"])
            continue
        if m["cdata"] is not None or m["tag"] is None:
            continue
        if not m["end"]:  # the page ends inside a tag
            break
        tag = m["tag"].lower()
        if tag in BREAKS:
            flush()
        if m["close"]:
            if tag in ("article", "main") and article:
                article -= 1
            for k in range(len(parts) - 1, -1, -1):
                if parts[k][0] == tag:
                    parts[k][1] -= 1
                    if not parts[k][1]:
                        flush()
                        del parts[k:]
                    break
            continue
        rest = m["rest"]
        if parts and parts[-1][0] == "head" and tag not in IN_HEAD:
            flush()
            parts.clear()
        if tag in ("article", "main"):
            # an article inside comments is a comment; a part left open ends where the article begins
            if not any(p[2].removeprefix("in ") in READERS for p in parts):
                flush()
                parts.clear()
                article += 1
                continue
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.end() if close else end
            continue
        if parts and parts[-1][0] == tag:
            parts[-1][1] += 1
        elif not parts or tag in CHROME:
            if _is_part(tag, rest, bool(article)):
                flush()
                name = next((w for x in _NAMES.finditer(rest) for w in re.split(r"[^a-z0-9]+", (x[1] or x[2] or x[3] or "").lower()) if w in PARTS), tag)
                parts.append([tag, 1, f"in {name}" if article and tag not in CHROME else name])
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """The places in ``a`` of a longest common subsequence with ``b``.

    Bit-parallel: a row of the table is one number with a bit for each line of ``b``, so the table
    of two pages of ten thousand lines is twelve megabytes.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not mid_a or not mid_b:
        return found
    where: dict = {}
    for j, x in enumerate(mid_b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(mid_b)) - 1
    row, rows = full, []
    for x in mid_a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # a zero bit: the table grows by one at that line of b
    i, j = len(mid_a), len(mid_b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(head + i)
    return found


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


def _keys(lines: list[tuple[str, str]]) -> tuple[list[int], list[list[int]]]:
    """What is aligned, as hashes: runs of lines of a part by its name, lines of the page by their text; and each one's lines.

    An article's lines are 0: they stand for themselves alone, so that pages with one article don't lose it.
    """
    keys: list[int] = []
    of: list[list[int]] = []
    inner = not any(zone == "article" for zone, _ in lines)
    part = None
    for k, (zone, text) in enumerate(lines):
        own = zone == "article" or inner and _inner(zone)
        if not own and zone != "page":
            if part == zone:
                of[-1].append(k)
                continue
            part = zone
            keys.append(_hash("part", zone))
        else:
            part = None
            keys.append(0 if own else _hash("page", text))
        of.append([k])
    return keys, of


def shared_runs(mine: list[int], other: list[int]) -> set[int]:
    """The places in ``mine`` of what two pages share, by their ``_keys``."""
    return common_lines([k or object() for k in mine], [k or object() for k in other])


def main_text(lines: list[tuple[str, str]], other: list[tuple[str, str]] | None) -> str:
    """The text left of a page once the lines that it shares with ``other`` are deleted.

    What the difference leaves is then held to the zones: parts beside the article go even where the
    other page lacks them, and an article, if there is one, is all of the main text. An article all of
    whose text is in parts that a class names (a letter with class ``reply``) is that text.
    """
    return _held(lines, set() if other is None else shared_runs(_keys(lines)[0], _keys(other)[0]))


def _held(lines: list[tuple[str, str]], runs: set[int]) -> str:
    """``main_text`` of a page without these runs of its ``_keys``."""
    gone = {k for i, of in enumerate(_keys(lines)[1]) if i in runs for k in of} if runs else set()
    left = [(zone, text) for k, (zone, text) in enumerate(lines) if k not in gone]
    if _marked(left) and not any(z == "article" for z, _ in left):
        return " ".join(text for z, text in left if _inner(z))
    zone = "article" if any(z == "article" for z, _ in left) else "page"
    return " ".join(text for z, text in left if z == zone)


def _inner(zone: str) -> bool:
    return zone.startswith("in ") and zone[3:] not in READERS and zone[3:] not in ALWAYS


def _marked(lines: list[tuple[str, str]]) -> bool:
    """Whether a page has an article: lines of one, or a named part that holds all that one has."""
    return any(zone == "article" or _inner(zone) for zone, _ in lines)


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_ARROW_LINES = pa.list_(pa.struct([("zone", pa.string()), ("text", pa.string())]))
_LINES = T.ArrayType(T.StructType([T.StructField("zone", T.StringType()), T.StructField("text", T.StringType())]))


def _outlines(batches):
    """Each page's content as a hash and what it is aligned by (``_keys``); without an article its lines too."""
    for batch in batches:
        sigs, keys, lines = [], [], []
        for html in batch.column(batch.schema.get_field_index("_html")):
            found = lines_of(html.as_py() or "")
            sigs.append(_hash(*[x for line in found for x in line]))
            keys.append(_keys(found)[0])
            lines.append(None if _marked(found) else [{"zone": z, "text": t} for z, t in found])
        kept = [c for c in batch.schema.names if c != "_html"]
        columns = [*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(sigs, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(lines, _ARROW_LINES)]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "_sig", "_keys", "_lines"])


def _read(batches):
    """Each page's content as a hash, and its lines."""
    for batch in batches:
        found = [lines_of(html.as_py() or "") for html in batch.column(batch.schema.get_field_index("_html"))]
        sigs = pa.array([_hash(*[x for line in page for x in line]) for page in found], pa.int64())
        lines = pa.array([[{"zone": z, "text": t} for z, t in page] for page in found], _ARROW_LINES)
        kept = [c for c in batch.schema.names if c != "_html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], sigs, lines], [*kept, "_sig", "_lines"])


def _compare(batches):
    """The runs that a page shares with its mate."""
    for batch in batches:
        pid, mine, other = (batch.column(batch.schema.get_field_index(c)) for c in ("_pid", "_keys", "_other"))
        runs = [sorted(shared_runs(x, y)) for x, y in zip(mine.to_pylist(), other.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pid, pa.array(runs, pa.list_(pa.int32()))], ["_of", "_runs"])


def _subtract(batches):
    for batch in batches:
        row, lines, runs = (batch.column(batch.schema.get_field_index(c)) for c in ("_row", "_lines", "_runs"))
        texts = [_held([(p["zone"], p["text"]) for p in x.as_py()], set(y.as_py() or ())) for x, y in zip(lines, runs, strict=True)]
        yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], ["_row", "_text"])


# --- the nearest page of other content, whatever the partitions ------------------

Seen = list[tuple[int, int, str]]  # of one host: (class, sig, path) of the last page, and of the last one of another class


def _push(seen: Seen, page: tuple[int, int, str]) -> Seen:
    return [page, *[x for x in seen if x[0] != page[0]][:1]]


def _other(seen: Seen, kind: int) -> tuple[int, int, str] | None:
    return next((x for x in seen if x[0] != kind), None)


def _walk(rows, carried=(None, [])):
    """For each (host, path, sig, class) the nearest earlier page of its host and of another class; then the state at the end."""
    host, seen = carried
    found = []
    for h, path, sig, kind in rows:
        if h != host:
            host, seen = h, []
        found.append(_other(seen, kind))
        seen = _push(seen, (kind, sig, path))
    return found, (host, seen)


def _rows(batches):
    return [r for b in batches for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_host", "_path", "_sig", "_class")), strict=True)]


def _carry(ends: list) -> dict:
    """What each partition starts with: the state of all before it, from each one's own (first host, last host, pages seen)."""
    out, host, seen = {}, None, []
    for part, first, last, own in ends:
        out[part] = (host, seen)
        if first == last == host:  # the host goes on through the whole partition
            seen = [*own, *[x for x in seen if all(x[0] != y[0] for y in own)]][:2]
        else:
            host, seen = last, own
    return out


def mates(pages: DataFrame) -> DataFrame:
    """(``_pid``, ``_mate``) for pages with ``_host``, ``_path``, ``_key``, ``_sig``, ``_class`` and ``_pid``.

    The mate is the content (``_sig``) of the page whose path agrees longest, the earlier on ties, of
    the nearest earlier and later ones in order of host, path and key that are of its host and of
    another class. Of each range partition only the last two classes at either end, a few hundred
    bytes, come to the driver and go on to the next ones, so ranges and settings don't matter.
    """
    from pyspark import TaskContext

    rows = pages.select("_host", "_path", "_key", "_sig", "_class", "_pid").dropDuplicates(["_pid"])
    rows = keep(rows.repartitionByRange("_host", "_path", "_key", "_sig").sortWithinPartitions("_host", "_path", "_key", "_sig").drop("_key"))

    def ends(batches):
        import pickle

        own = _rows(batches)
        if own:
            state = (TaskContext.get().partitionId(), own[0][0], own[-1][0], _walk(own)[1][1], _walk(own[::-1])[1][1])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["x"])

    import pickle

    states = sorted(pickle.loads(bytes(r["x"])) for r in rows.transform(in_python, ends, "x binary").collect())
    before = _carry([(p, a, b, fore) for p, a, b, fore, _ in states])
    after = _carry([(p, b, a, back) for p, a, b, _, back in states][::-1])

    def pair(batches):
        held = list(batches)
        own, part = _rows(held), TaskContext.get().partitionId()
        if own:
            early, late = _walk(own, before[part])[0], _walk(own[::-1], after[part])[0][::-1]
            picked = [max([m for m in (x, y) if m], key=lambda m, path=r[1]: _near(m[2] or "", path or ""), default=None) for r, x, y in zip(own, early, late, strict=True)]
            pids = [x for b in held for x in b.column(b.schema.get_field_index("_pid")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array([m and m[1] for m in picked], pa.int64())], ["_pid", "_mate"])

    return rows.transform(in_python, pair, "_pid long, _mate long")


#: Pages without an article are near copies where so many of 100 of the runs of 4 words of both are shared, their
#: host's frame apart: the lines that every page of a host has, where it has at least ``FRAME`` of different content.
NEAR_COPIES, FRAME = 85, 3


def own_lines(pages: DataFrame) -> DataFrame:
    """(``_hid``, ``_own``): the text of each page but its host's frame, for distinct ``_hid`` with ``_hkey`` and ``_lines``.

    Lines are counted by host and hash before the shuffle; a host's frame has no more lines than any of its pages.
    """
    texts = F.transform(F.filter("_lines", lambda x: x["zone"] == "page"), lambda x: x["text"])
    pages = pages.select("_hid", "_hkey", texts.alias("_texts"))
    each = pages.select("_hkey", F.explode(F.array_distinct(F.transform("_texts", lambda x: F.xxhash64(x)))).alias("_line"))
    host = pages.groupBy("_hkey").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= FRAME)
    frame = each.groupBy("_hkey", "_line").agg(F.count(F.lit(1)).alias("_k")).join(host, "_hkey").where("_k = _n").groupBy("_hkey").agg(F.collect_list("_line").alias("_frame"))
    rest = F.filter("_texts", lambda x: ~F.coalesce(F.array_contains("_frame", F.xxhash64(x)), F.lit(False)))
    return pages.join(frame, "_hkey", "left").select("_hid", F.array_join(rest, "\n").alias("_own"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every row without ``html``, with ``text`` (the main text, empty if none) and ``n_chars`` (its code points).

    A page loses the lines that it shares with the nearest URL of its host, in order of host, path and
    key, that is no copy of it and, where it has no article, no near copy
    (``NEAR_COPIES``, and chains of them, by the lines that are not on all pages of the host): copies
    keep their text. The lines of an article are its own, and are never shared. A host all of whose pages share a story under different titles has that story as
    its frame, as no other page tells it from a menu. The nearest page doesn't depend
    on partitions, and no host, however large, meets in one task. Pages without lines are no one's
    nearest. Null URLs form a host of their own; null and empty html give an empty text; a page whose
    host has no page of other content is held to its zones only. Pages of any length are whole. Columns named ``text`` or ``n_chars``
    are replaced, whatever their case. Contents and lines are compared by 64-bit hashes.
    """
    columns = [pages[c] for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    rows = pages.select(F.struct(*columns).alias("_row"), host_of(pages[url]).alias("_host"), path_of(pages[url]).alias("_path"), pages[key].alias("_key"), pages[html].cast("string").alias("_html"))
    schema = lambda dropped, *more: T.StructType([f for f in rows.schema if f.name not in ("_html", *dropped)] + [T.StructField(n, t) for n, t in more])
    # content by its lines; of a page, by its place too
    pid = F.xxhash64("_host", F.col("_host").isNull(), "_path", "_key", F.col("_key").isNull(), "_sig")
    # lines are made twice of the pages and never stored: first what pages are aligned by, then what is left of them
    outlines = rows.drop("_row").transform(in_python, _outlines, schema(["_row"], ("_sig", T.LongType()), ("_keys", T.ArrayType(T.LongType())), ("_lines", _LINES)))
    hkey = F.xxhash64("_host", F.col("_host").isNull())
    outlines = keep(outlines.where("size(_keys) > 0").withColumn("_pid", pid).withColumn("_hkey", hkey).withColumn("_hid", F.xxhash64("_hkey", "_sig")))
    placed = outlines.select("_host", "_path", "_key", "_sig", "_pid", "_hid").withColumn("_class", F.col("_hid"))
    open_ = outlines.where("_lines is not null")
    if open_.limit(1).count():
        # written down, as the join reads its texts several times
        linked = link(keep(own_lines(open_.dropDuplicates(["_hid"]))), 4, NEAR_COPIES, "_hid", "_own")
        classes = keep(linked.select(F.col("id").alias("_hid"), F.col("component_id").alias("_near")))
        placed = placed.join(classes, "_hid", "left").withColumn("_class", F.coalesce("_near", "_hid")).drop("_near")
    mine = outlines.select("_pid", "_keys").dropDuplicates(["_pid"])
    other = outlines.select(F.col("_sig").alias("_mate"), F.col("_keys").alias("_other")).dropDuplicates(["_mate"])
    pairs = mates(placed).where("_mate is not null").join(mine, "_pid").join(other, "_mate")
    runs = pairs.transform(in_python, _compare, "_of long, _runs array<int>")
    read = rows.transform(in_python, _read, schema([], ("_sig", T.LongType()), ("_lines", _LINES))).select("_row", "_lines", pid.alias("_pid"))
    # the side of the runs is small and is looked up, so lines are not sorted
    paired = read.join(runs.hint("shuffle_hash"), F.col("_pid") == F.col("_of"), "left").select("_row", "_lines", "_runs")
    done = paired.transform(in_python, _subtract, T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType())]))
    return done.select("_row.*", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
