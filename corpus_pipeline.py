"""A training corpus from raw documents: filtered, deduplicated, mixed and packed.

Each stage takes all that the one before it kept, as Parquet, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import mixing, ngram_join, packing, quality, substrings
from reviewlens.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: too short, too repetitive, or caught by a rule learned from the labels."""
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 80 % of their 5-word shingles link, the one of the smallest id stays."""
    return ngram_join.keep_one(docs, 5, 80).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier in the corpus are cut out; texts without any stay as they are."""
    done = substrings.deduplicate(docs.select(*COLUMNS), 20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mixture takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in sequences of at most 4096 tokens: a row for each piece of a document, with its token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, approximate dual solutions and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    with Scratch(spark) as tmp:
        for name, stage in STAGES[:-1]:
            docs = tmp.write(stage(spark, docs, sf_dir), name)
        # the last stage keeps its pieces, so the tables may go
        return STAGES[-1][1](spark, docs, sf_dir)
