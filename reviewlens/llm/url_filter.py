"""URL filters: rules by host and path, and a blocked Bloom filter before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.bloom import BROADCAST_BLOCKS, block_of, bloom, blocks_for, in_bloom
from reviewlens.llm.common import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tasks over which a listed URL's rows spread in the exact join.
SALTS = 16

#: Parameters that tell only where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref)(=|$)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, other than tracking parameters in order; no fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    kept = F.array_join(kept, "&")
    where = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(kept != "", F.concat(where, F.lit("?"), kept)).otherwise(where)


def listed_among(pages: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """``pages`` with ``listed`` (boolean, replaced if there): whether ``key`` is in the one-column table ``listed``.

    The filter, 16 bits or more for each listed key, clears most rows; the rows it passes meet the
    list itself in an exact join, which removes its false positives. Null keys are not listed;
    repeated keys in the list count once; either table may be empty.
    """
    pages = pages.select(F.struct(*[pages[c] for c in pages.columns if c.lower() != "listed"]).alias("_row"), pages[key].alias("_key"))
    listed = keep(listed.toDF("_listed").where("_listed is not null").distinct())
    blocks = blocks_for(listed.count())
    bits = bloom(listed, "_listed", blocks)
    if blocks <= BROADCAST_BLOCKS:
        bits = F.broadcast(bits)
    probed = pages.withColumn("_block", block_of(F.coalesce(F.col("_key"), F.lit("")), blocks))
    probed = probed.join(bits, probed["_block"] == bits["_at"], "left").withColumn("_maybe", in_bloom(F.col("_key"))).select("_row", "_key", "_maybe")
    # rows that the filter clears don't enter the join: their keys would only travel
    clear = probed.where(~F.col("_maybe")).select("_row.*", F.lit(False).alias("listed"))
    maybe = probed.where("_maybe").select("_row", "_key")
    # a key that very many rows have meets the list in several tasks
    maybe = maybe.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salted = listed.withColumn("_nth", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = maybe.join(salted, (F.col("_key") == F.col("_listed")) & (F.col("_salt") == F.col("_nth")), "left")
    hits = hits.select("_row.*", F.col("_listed").isNotNull().alias("listed"))
    return clear.unionByName(hits)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (action, host, path) that fits, as ``host`` + ``path``, and its action; null if none does.

    A rule fits its host and all subdomains where the path starts with its own. The rules are a
    parameter of at most a few hundred, compiled into one conditional expression, longest first.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """Judge every row's URL: ``host``, ``path``, ``rule``, ``verdict``.

    The longest fitting rule decides; without one, a row is blocked if its canonical URL is in
    ``listed`` (one column of canonical URLs), else allowed. A null URL, or one without ``://``, has
    an empty host and path, no rule, and is allowed unless the list holds the empty string. Columns
    with the added names are replaced; rows are never dropped or merged.
    """
    columns = [pages[c] for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*columns).alias("_row"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), F.coalesce(canonical(pages[url]), F.lit("")).alias("canonical"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return listed_among(rows, listed).select("_row.*", "host", "path", name.alias("rule"), verdict.alias("verdict"))
