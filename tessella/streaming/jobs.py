"""Streams: usage by time window, and tables ingested as pages arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import grid


def usage_windows(events: DataFrame, *, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, batch or stream: events(ts, event_type, value). Rows later than the watermark are not counted."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    made = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    made = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest_pages(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse tables of arriving pages(doc_id, raw) and keep their cells by document; a document that comes again is replaced.

    Of several pages of a document in one batch the last by ``ts`` counts; without that column, or at equal times, the
    largest text, so that a repeated batch gives the same.
    """

    def store(batch: DataFrame, _: int) -> None:
        order = F.struct("ts", "raw") if "ts" in batch.columns else F.col("raw")
        last = batch.groupBy("doc_id").agg(F.max_by("raw", order).alias("raw"))
        found = grid.extract_tables(last).withColumn("table_id", F.concat_ws(":", "doc_id", "table_no"))
        cells = grid.parse_cells(found).withColumn("doc_id", F.split_part("table_id", F.lit(":"), F.lit(1)))
        cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
