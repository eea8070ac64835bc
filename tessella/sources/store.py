"""Recognised tables, chunks and answers at rest, and the files that are handed out.

All are Parquet folders partitioned by what is replaced together; a write replaces
only the partitions it holds rows for (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import usage_summary
from ..scratch import cut


def save_tables(tables: DataFrame, path: str, fingerprint: str) -> None:
    """Replace each file's tables; a file without tables writes nothing and so is tried again."""
    rows = tables.where(F.col("html").isNotNull()).withColumn("prompt_fp", F.lit(fingerprint))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)


def load_tables(spark: SparkSession, path: str, file_ids: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path).withColumn("file_id", F.col("file_id").cast("string"))
    return table if file_ids is None else table.where(F.col("file_id").isin(file_ids))


def missing(files: DataFrame, stored: DataFrame | None, fingerprint: str) -> DataFrame:
    """Files to recognise: originals only, without tables made under the same prompts."""
    todo = files.where(F.col("dedup_of").isNull()) if "dedup_of" in files.columns else files
    return todo if stored is None else todo.join(stored.where(F.col("prompt_fp") == fingerprint).select("file_id").distinct(), "file_id", "left_anti")


def needed(files: DataFrame, questions: DataFrame) -> DataFrame:
    return files.join(questions.select("file_name").distinct(), "file_name", "left_semi")


def unanswered(questions: DataFrame, answers: DataFrame | None) -> DataFrame:
    return questions if answers is None else questions.join(answers.select("question_id").distinct(), "question_id", "left_anti")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str = "file_id") -> None:
    """Insert chunks, or replace those of the same ``chunk_id`` and ``key``; other chunks of the same partitions stay.

    Only partitions that ``rows`` has chunks for are written. Ids repeated in ``rows`` must be the same chunk.
    """
    new = rows.dropDuplicates(["chunk_id"])
    fs, at = _files(spark, path)
    if fs.exists(at):
        held = spark.read.parquet(path).withColumn(key, F.col(key).cast(rows.schema[key].dataType))
        touched = held.join(new.select(key).distinct(), key, "left_semi").join(new.select(key, "chunk_id"), [key, "chunk_id"], "left_anti")
        new = cut(new.unionByName(touched, allowMissingColumns=True), "upsert")  # read before its partitions are replaced
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def remove_file(spark: SparkSession, path: str, file_id: str, key: str = "file_id") -> int:
    """Delete a file's partition; the number of chunks that went."""
    held = spark.read.parquet(path).where(F.col(key).cast("string") == file_id)
    n = held.count()
    for (name,) in held.select(F.regexp_extract("_metadata.file_path", "^(.*)/", 1)).distinct().collect():  # one folder
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        _files(spark, path)[0].delete(folder, True)
    return n


def save_answers(answers: DataFrame, path: str) -> None:
    """Add answer records; of several records of a question the last one written counts."""
    answers.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each question."""
    held = spark.read.parquet(path)
    kept = [c for c in held.columns if c not in ("question_id", "written")]
    last = held.groupBy("question_id").agg(F.max_by(F.struct(*kept), "written").alias("_r"))
    return last.select("question_id", "_r.*")


def delete_file(chunks: DataFrame, file_id: str) -> DataFrame:
    """The collection without one file's chunks."""
    return chunks.where(~F.col("file_id").eqNullSafe(F.lit(file_id)))


def browse(chunks: DataFrame, file_name: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the collection in order of chunk_id; at most 100 rows a page, as the serving interface says."""
    rows = chunks if file_name is None else chunks.where(F.col("file_name") == file_name)
    return rows.orderBy("chunk_id").offset(max(0, offset)).limit(max(1, min(100, limit)))


def submission(answers: DataFrame, skipped: DataFrame) -> DataFrame:
    """id and answer of every question: answered ones, then skipped ids that have none, once each and empty."""
    done = answers.select(F.col("question_id").alias("id"), F.coalesce("answer", F.lit("")).alias("answer"), F.lit(0).alias("part"))
    ids = skipped.where(F.coalesce("id", F.lit("")) != "").select("id").distinct()
    return done.union(ids.join(done.select("id"), "id", "left_anti").select("id", F.lit("").alias("answer"), F.lit(1).alias("part")))


def debug_sheet(answers: DataFrame) -> DataFrame:
    return answers.select(F.col("question_id").alias("id"), "answer", "confidence", "score", F.concat_ws(";", "events").alias("events"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def cost_report(usage: DataFrame) -> bytes:
    """Cost by phase with a total, as CSV text for spreadsheets (UTF-8 with a byte order mark); a row a phase."""
    rows = sorted(usage_summary(usage).collect(), key=lambda r: (r["phase"] == "TOTAL", r["phase"] or ""))
    lines = ["phase,input_tokens,output_tokens,total_tokens,calls", *(",".join(map(str, r)) for r in rows)]
    return b"\xef\xbb\xbf" + ("\n".join(lines) + "\n").encode()


def rewrite_fingerprint(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Mark the stored tables of one fingerprint as those of another; files without such tables are not written."""
    held = load_tables(spark, path)
    hit = held.where(F.col("prompt_fp") == old).select("file_id").distinct()
    rows = cut(held.join(hit, "file_id", "left_semi").withColumn("prompt_fp", F.when(F.col("prompt_fp") == old, new).otherwise(F.col("prompt_fp"))), "fingerprint")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)
