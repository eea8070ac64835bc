"""Document files: listing, content hashes, duplicates and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# Suffixes that are documents.
SUFFIXES = ["pdf", "png", "jpg", "jpeg", "webp", "bmp"]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: file_name, path, length, file_id (start of the SHA-1 of the content)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES + [s.upper() for s in SUFFIXES]) + "}").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "length", file_id(F.col("content")).alias("file_id"))


def file_id(content: Column) -> Column:
    return F.substr(F.sha1(content), F.lit(1), F.lit(12))


def deduplicate(files: DataFrame, key: str = "file_id", name: str = "file_name") -> DataFrame:
    """Adds ``dedup_of``: the first name, in order, with the same content; null for that one itself.

    The first name of a content is a combined aggregate joined back, so a content
    that very many files share is no single task's work.
    """
    first = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(name).alias("_first"))
    return files.join(first, key, "left").withColumn("dedup_of", F.when(F.col(name) != F.col("_first"), F.col("_first"))).drop("_first")


def category(suffix: Column, text: Column, pages: Column, lines: Column, chars_per_page: int = 50) -> Column:
    """B for PDFs with a sound text layer, D for others; images F with under three axis-parallel lines, else C."""
    pdf = F.when((F.length(F.coalesce(text, F.lit(""))) / F.greatest(pages, F.lit(1)) > chars_per_page) & ~X.garbled_layer(text), "B").otherwise("D")
    return F.when(F.lower(suffix) == "pdf", pdf).when(lines < 3, "F").otherwise("C")


def pages_of(files: DataFrame) -> DataFrame:
    """One row for each page: ``n_pages`` for PDFs, one for images."""
    return files.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("n_pages", F.lit(1)), F.lit(1)))).alias("page"))


