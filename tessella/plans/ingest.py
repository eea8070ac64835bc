"""Ingest: files to recognised tables, chunks and vectors, all originals at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import prompts
from ..operators import grid, retrieve
from ..scratch import cut
from ..sources import store
from . import seams


def route(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages for the text-layer reader (categories A and B) and pages for the vision model."""
    by_text = F.col("category").isin("A", "B")
    return pages.where(by_text), pages.where(~by_text | F.col("category").isNull())


def recognise(pages: DataFrame, read: Callable[[str, str, int], str | None], see: Callable[[str, str, int], str | None]) -> DataFrame:
    """Tables of pages(file_id, path, page, category): the text layer where there is one, the vision model for
    the rest and for pages on which the text layer gave no table."""
    first, second = route(pages)
    found = cut(seams.recognise(first, read), "read").where(F.col("raw").rlike("(?i)<table"))
    again = first.join(found.select("file_id", "page"), ["file_id", "page"], "left_anti")
    seen = seams.recognise(second.unionByName(again), see)
    both = found.withColumn("source_engine", F.lit("text")).union(seen.withColumn("source_engine", F.lit("vision")))
    both = cut(both.withColumn("doc_id", F.concat_ws(":p", "file_id", "page")), "recognised")
    tables = grid.extract_tables(both).join(both.select("doc_id", "file_id", "page", "source_engine"), "doc_id")
    return tables.select(F.concat_ws(":", "doc_id", "table_no").alias("table_id"), "file_id", "page", "table_name", "html", "source_engine")


def chunks(tables: DataFrame, files: DataFrame, annotations: DataFrame | None = None, embed: Callable[[Column], Column] = seams.hashed_vector) -> DataFrame:
    """One chunk for each table: its text, vector and facts. ``annotations``: table_id, annotation (a model's one line); null or none gives the header's names."""
    cells = cut(grid.parse_cells(tables), "cells")
    rows = tables.join(files.where("dedup_of IS NULL").select("file_id", "file_name"), "file_id").join(grid.table_facts(cells), "table_id")
    rows = rows.withColumn("annotation", F.lit(None).cast("string")) if annotations is None else rows.join(annotations.select("table_id", "annotation"), "table_id", "left")
    text = retrieve.chunk_text(*(F.col(c) for c in ("file_name", "table_name", "page", "n_rows", "n_cols", "unit_note", "annotation", "headers", "html")))
    said = rows.withColumn("chunk_text", text).withColumn("chunk_id", F.col("table_id"))
    return said.withColumn("vector", embed(F.col("chunk_text"))).select("chunk_id", "table_id", "file_id", "file_name", "table_name", "page", "n_rows", "n_cols", "source_engine", "chunk_text", "vector")


def ingest(files: DataFrame, pages: DataFrame, stored: DataFrame | None, fingerprint: str, read, see, tables_path: str, chunks_path: str) -> int:
    """Recognise and keep what is missing; the number of tables kept."""
    todo = store.missing(files, stored, fingerprint)
    tables = cut(recognise(pages.join(todo.select("file_id"), "file_id", "left_semi"), read, see), "tables")
    store.save_tables(tables, tables_path, fingerprint)
    store.upsert(tables.sparkSession, chunks(tables, files), chunks_path)
    return tables.count()


def reindex(tables: DataFrame, files: DataFrame, held: DataFrame, path: str) -> None:
    """Make the chunks of files anew whose template is old or whose number of chunks differs."""
    want = tables.groupBy("file_id").agg(F.count("*").alias("want"))
    state = want.join(retrieve.fresh_template(held), "file_id", "left")
    stale = state.where(~F.coalesce(F.col("fresh") & (F.col("want") == F.col("chunks")), F.lit(False))).select("file_id")
    store.upsert(tables.sparkSession, chunks(tables.join(stale, "file_id", "left_semi"), files), path)


def annotate(tables: DataFrame, template: str, chat: Callable[[str], str], **call) -> DataFrame:
    """One line about each table from a model: table_id, annotation. ``template`` may name the table's columns; a failed call gives an empty line."""
    asked = tables.select(F.col("table_id").alias("question_id"), F.lit("annotate").alias("phase"), prompts.rendered(template, {c: F.col(c) for c in tables.columns}).alias("prompt"))
    said = seams.call_model(asked, chat, **call)
    line = F.trim(F.regexp_replace(F.coalesce("reply", F.lit("")), r"\s+", " "))
    return said.select(F.col("question_id").alias("table_id"), line.alias("annotation"))
