"""A training-data pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, minhash_dedup, pack, quality, substring_dedup
from tessella.scratch import cut, drop

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a passage that counts as repeated, and of one that counts as leaked. Passages of over 50 words are
#: meant; a few words less, since those at its ends may be joined to what stands beside them.
REPEATED_WORDS = 45
LEAKED_WORDS = 8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels not held out, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~quality.held_out()))
    return quality.score(docs.select(COLUMNS), model, as_col="_score").where("_score >= 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs.select(COLUMNS), gram=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has too; those with nothing left go."""
    found = substring_dedup.dedup_substrings(docs, window=REPEATED_WORDS, carry=["doc_id", "lang", "source"])
    left = found.where("n_removed = 0 OR n_removed < n_words").withColumnRenamed("kept_text", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminate(docs.select(COLUMNS), items, window=LEAKED_WORDS).where("n_hit = 0").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024, one row for each piece of a document."""
    import public_tokenizers

    return pack.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", leaked_benchmarks),
    ("packing", packing),
]

#: Neither the learned model nor the tokenizer can be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            after = cut(after, f"stage-{i}")
            drop(docs)  # a stage's table is not read once the next one's is written
        docs = after
    return docs
