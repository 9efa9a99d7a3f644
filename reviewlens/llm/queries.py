"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import byte_bpe, html_text, language, media, mixing, ngram_join, packing, periodic, quality, sharding, substrings, url_filter, whitening
from reviewlens.llm.common import keep, table

#: Fixed values of the URL query: (action, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by at most one, each with the sources' mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    dealt = sharding.interleave(docs, 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by a list: canonical URLs captured more than once."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    again = pages.where("url is not null").groupBy(url_filter.canonical(F.col("url")).alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and c != ''").select("c")
    return url_filter.filter_urls(pages, URL_RULES, again).select("page_id", "host", "path", "rule", "verdict")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, judged by the rules learned from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of 85 % of the union of their 4-word shingles."""
    return ngram_join.link(table(spark, sf_dir, "documents"), 4, 85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a recording: its chroma fingerprint, its class, and for every twentieth its alignments."""
    prints = media.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", media.tones)
    done = media.align(prints)
    return done.select(F.col("id").alias("vec_id"), "frames", F.crc32(F.array_join("fingerprint", ",")).alias("print_crc32"), "class_id", "match_id", "offset", "bit_error", "matches")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four fifths of the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.learn(docs)
    rows = docs.select("doc_id", "text")
    # ids and predictions travel; texts only into the workers
    out = language.predict(rows.withColumn("held_out", language.held_out(F.col("doc_id"))).select("doc_id", "held_out", "text"), net)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 20 words that start earlier in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substrings.deduplicate(docs, 20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mixture takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # the texts are read once: what follows goes over ids, sources and sizes
    docs = keep(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words")))
    mixed = mixing.mix(docs, size="words")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "rate")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, and the bytes that they decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words, a tenth of the documents with a repeated tail, and what is left without the repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = periodic.collapse(docs, key="doc_id", least=6, times=4, tail=periodic.repeated_tail, outputs=False)
    return done.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector on the first four whitened components of all distinct ones."""
    done = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", components=4, scale=256)
    # a long holds it up to some 100 million vectors; beyond it is null here, and whole in the operator's decimal
    return done.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


ALL = [op1_sharding, op2_html_text, op3_url_filter, op4_quality, op5_ngram_join, op6_media, op7_packing, op8_language, op9_substrings, op10_mixing, op11_byte_bpe, op12_periodic_runs, op13_whitening]
