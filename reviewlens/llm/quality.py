"""Quality rules: text statistics, and decision lists learned from labelled statistics by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import SPACES, free_name, keep, let, words

WINDOW = 5
#: Bits of a packed number that hold a position; longer texts use the second.
SHORT, LONG = 20, 31


def _window(h: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])


def repeated_words(w: Column) -> Column:
    """How many of the words ``w`` stand in a window of five words that occurs twice or more.

    Windows are compared by their 64-bit hashes, each computed once; a text of distinct ones is done.
    Otherwise each hash, its low bits replaced by its position, is one long; sorted, equal windows are
    neighbours, and neighbours that agree in the high bits are compared by their whole hashes.
    """

    def of(h: Column, mask: Column) -> Column:
        at = lambda x: F.get(h, x.bitwiseAND(F.bitwise_not(mask)).cast("int"))
        same = lambda p, x, k: F.coalesce((F.get(p, k).bitwiseAND(mask) == x.bitwiseAND(mask)) & (at(F.get(p, k)) == at(x)), F.lit(False))
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("long"))))
        twice = let(packed, lambda p: F.filter(p, lambda x, k: same(p, x, k - 1) | same(p, x, k + 1)))
        starts = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.bitwise_not(mask))))
        gained = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.lit(WINDOW).cast("long"), F.coalesce(x - F.get(s, k - 1), F.lit(WINDOW).cast("long")))))
        return F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x)

    mask = lambda h: F.when(F.size(h) < 1 << SHORT, F.lit(-(1 << SHORT))).otherwise(F.lit(-(1 << LONG))).cast("long")
    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: _window(h, i)))
    many = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(mask(h), lambda m: of(h, m))))
    return F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(many)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``, ``n_digits``, ``n_upper`` (long).

    They count over the whole text; null and empty texts count 0 everywhere. Columns of these names are replaced.
    """
    _w, _l = free_name(docs, "w"), free_name(docs, "l")
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.drop(*STATISTICS).withColumns({_w: both, _l: line})
    return out.withColumns(
        {
            "n_words": F.col(f"{_w}.n"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": gone("#*$%&|<>").cast("long"),
            "n_dup_lines": F.col(f"{_l}.d"),
            "n_repeat_words": F.col(f"{_w}.r"),
            "n_lines": F.col(f"{_l}.n"),
            "n_digits": gone("0123456789").cast("long"),
            "n_upper": gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        }
    ).drop(_w, _l)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: The statistics that the rules may test.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _per("word_chars", "n_words"),
    "symbol_share": lambda: _per("n_symbols", "word_chars"),
    "dup_line_share": lambda: _per("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _per("n_repeat_words", "n_words"),
    "digit_share": lambda: _per("n_digits", "word_chars"),
    "upper_share": lambda: _per("n_upper", "word_chars"),
    "words_per_line": lambda: _per("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def fires(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the number of the first rule that fires, from 1; 0 if none."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(fires(rule), k) if out is None else out.when(fires(rule), k)
    return F.lit(0) if out is None else out.otherwise(0)


def learn(rows: DataFrame, bins: int = 24, most_rules: int = 6, most_conditions: int = 3, least_precision: float = 0.9, least_covered: int = 8) -> list[Rule]:
    """Learn an ordered list of rejecting rules from ``rows``: the statistics and ``bad`` (boolean).

    Sequential covering: a rule grows on two thirds of the rows by the condition of the highest
    information gain, is pruned from its end on the other third, and is taken if it still rejects
    with ``least_precision`` there; the rows that it covers leave, and the next rule is grown. Every
    step is one aggregation that returns (features x bins) counts; no row comes to the driver.
    """
    rows = keep(rows.select(*[FEATURES[f]().alias(f) for f in FEATURES], F.col("bad").cast("int").alias("bad"), (F.pmod(F.col("_h"), F.lit(3)) == 0).alias("prune")))
    at = [k / bins for k in range(1, bins)]
    # quantiles of either class, so that a rare class has thresholds of its own
    cuts_of = rows.groupBy("bad").agg(*[F.percentile_approx(f, at, 10000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({x for r in cuts_of for x in r[f] or []}) for f in FEATURES}
    binned = {f: sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)) for f in FEATURES if cuts[f]}
    if not binned:
        return []
    rows = keep(rows.select("*", F.array(*[F.struct(F.lit(f).alias("f"), b.alias("b")) for f, b in binned.items()]).alias("at")))

    def test(c: Condition) -> Column:
        return F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold

    def both(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & test(c)
        return out

    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules:
        rule: Rule = ()
        while len(rule) < most_conditions:
            counts = left.where(~F.col("prune") & both(rule)).select("bad", F.explode("at").alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            best = _best(counts, cuts)
            if best is None or best[0] in rule:
                break
            rule, done = (*rule, best[0]), best[1]
            if done:
                break
        if not rule:
            break
        tried = left.where("prune").agg(*[F.sum(both(rule[:k]).cast("int") * F.col("bad")).alias(f"p{k}") for k in range(1, len(rule) + 1)], *[F.sum(both(rule[:k]).cast("int") * (1 - F.col("bad"))).alias(f"n{k}") for k in range(1, len(rule) + 1)]).first()
        worth = lambda k: ((tried[f"p{k}"] or 0) - (tried[f"n{k}"] or 0)) / max(1, (tried[f"p{k}"] or 0) + (tried[f"n{k}"] or 0))
        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        p, n = tried[f"p{k}"] or 0, tried[f"n{k}"] or 0
        if p + n < least_covered or p < least_precision * (p + n):
            break
        rules.append(rule[:k])
        left = left.where(~both(rule[:k]))
    return rules


def _best(counts: list, cuts: dict[str, list[float]]) -> tuple[Condition, bool] | None:
    """The condition of the highest information gain from counts by feature and bin, and whether it leaves no good row."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    found, gain = None, 1e-9
    for f in sorted(by):
        total_p, total_n = (sum(x[i] for x in by[f].values()) for i in (0, 1))
        if not total_p or not total_n:
            return None
        before, p, n = math.log2(total_p / (total_p + total_n)), 0, 0
        for b, cut in enumerate(cuts[f]):
            p, n = p + by[f].get(b, (0, 0))[0], n + by[f].get(b, (0, 0))[1]
            for above, pp, nn in ((False, p, n), (True, total_p - p, total_n - n)):
                if pp and (g := pp * (math.log2(pp / (pp + nn)) - before)) > gain:
                    found, gain = (Condition(f, above, cut), nn == 0), g
    return found


#: At most so many labelled rows are learned from, those of the lowest hash of their id.
LABELLED = 20_000


def learn_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED) -> list[Rule]:
    """The rules learned from the documents that ``labels`` covers (``label`` 0: bad), at most ``labelled`` of them.

    Null keys and null labels teach nothing; of several labels for a key the lowest counts. Without
    labelled documents the list is empty and rejects nothing.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(label) == 0).alias("bad"))
    known = keep(known.withColumn("_h", F.xxhash64(F.col("_key"), F.lit(23))).orderBy("_h", "_key").limit(labelled))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(known), F.col("_k") == F.col("_key"))
    return learn(with_stats(rows.drop("_key"), "_t").where(~base_failed()))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the statistics, ``base_failed``, ``rule`` (0: none fired) and ``kept`` to every row."""
    added = [*STATISTICS, "base_failed", "rule", "kept"]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c.lower() not in added]).alias("_row"), docs[text].alias("_text"))
    out = with_stats(rows, "_text").withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).select("_row.*", *added)
