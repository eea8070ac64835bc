"""Command line: answer a sheet of questions, ingest recognised pages, index their tables anew, or serve the stores."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import logs
from .operators import grid, questions, retrieve
from .plans import ingest as making
from .plans import seams
from .plans.answer import answer
from .sources import store
from .sources.sheets import read_sheet


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = store._files(spark, path)
    return fs.exists(at)


def _ingest(spark: SparkSession, args) -> None:
    pages = spark.read.parquet(args.pages).withColumn("doc_id", F.concat_ws(":p", "file_id", "page"))
    held = store.load_tables(spark, args.out) if _exists(spark, args.out) else None
    todo = store.missing(pages.select("file_id", "file_name").distinct(), held, args.fingerprint)
    pages = pages.join(todo.select("file_id"), "file_id", "left_semi")
    found = grid.extract_tables(pages).join(pages.drop("raw"), "doc_id").withColumn("table_id", F.concat_ws(":", "doc_id", "table_no"))
    store.save_tables(found, args.out, args.fingerprint)
    if args.chunks:
        tables = store.load_tables(spark, args.out).withColumn("source_engine", F.lit("recognised"))
        names = tables.select("file_id", "file_name").distinct().withColumn("dedup_of", F.lit(None).cast("string"))
        store.upsert(spark, making.chunks(tables.drop("file_name"), names), args.chunks)


def _reindex(spark: SparkSession, args) -> None:
    tables = store.load_tables(spark, args.tables).withColumn("source_engine", F.lit("recognised"))
    names = tables.select("file_id", "file_name").distinct().withColumn("dedup_of", F.lit(None).cast("string"))
    making.reindex(tables.drop("file_name"), names, spark.read.parquet(args.chunks), args.chunks)


def _run(spark: SparkSession, args) -> None:
    tables = spark.read.parquet(args.tables)
    asked, skipped = questions.clean(read_sheet(spark, args.sheet), tables.select("file_name"))
    asked = questions.only(asked, args.only, args.limit)
    records = f"{args.out}/records"
    held = store.load_answers(spark, records) if args.resume and _exists(spark, records) else None
    todo = store.unanswered(asked, held)
    replies = spark.read.parquet(args.replies) if args.replies else spark.createDataFrame([], "question_id string, phase string, reply string")
    hits = None
    if args.chunks:
        chunks = spark.read.parquet(args.chunks)
        near = retrieve.search(todo.select(F.col("question_id").alias("query_id"), "file_name", seams.hashed_vector(F.col("question")).alias("vector")), chunks, by="file_name")
        hits = retrieve.rerank(near.join(todo.select(F.col("question_id").alias("query_id"), "question"), "query_id"))
    store.save_answers(answer(todo, tables, replies, hits), records)
    answers = store.load_answers(spark, records).join(asked.select("question_id"), "question_id", "left_semi")
    store.write_csv(store.submission(answers, skipped).orderBy("part", "id").drop("part"), f"{args.out}/submission")
    store.write_csv(store.debug_sheet(answers), f"{args.out}/debug")
    if not skipped.isEmpty():
        store.write_csv(skipped, f"{args.out}/skipped")


def _web(spark: SparkSession, args) -> None:
    from .web import Service, server

    asked, _ = questions.clean(read_sheet(spark, args.sheet), spark.read.parquet(args.tables).select("file_name"))
    none = spark.createDataFrame([], "file_name string, category string")
    usage = spark.read.parquet(args.usage) if args.usage else spark.createDataFrame([], "phase string, input_tokens long, output_tokens long")
    service = Service(asked, none, lambda: store.load_answers(spark, args.records), usage, spark.read.parquet(args.chunks), args.prompts)
    server(service, args.host, args.port).serve_forever()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("--logs", help="folder of rolling logs")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="answer a question sheet")
    run.add_argument("--sheet", required=True)
    run.add_argument("--tables", required=True, help="Parquet of table_id, file_name, table_name, page, html")
    run.add_argument("--replies", help="Parquet of question_id, phase, reply")
    run.add_argument("--chunks", help="Parquet of indexed chunks, for the choice of tables")
    run.add_argument("--only", nargs="*", default=[])
    run.add_argument("--limit", type=int)
    run.add_argument("--resume", action="store_true", help="keep the records that are there")
    run.add_argument("--out", required=True)
    ingest = commands.add_parser("ingest", help="tables and chunks of recognised pages that are not stored yet")
    ingest.add_argument("--pages", required=True, help="Parquet of file_id, file_name, page, raw")
    ingest.add_argument("--fingerprint", default="none")
    ingest.add_argument("--chunks", help="where the chunks go; none without it")
    ingest.add_argument("--out", required=True)
    again = commands.add_parser("reindex", help="make old or missing chunks anew")
    again.add_argument("--tables", required=True)
    again.add_argument("--chunks", required=True)
    web = commands.add_parser("web", help="serve questions, records and chunks as JSON")
    for name in ("sheet", "tables", "records", "chunks"):
        web.add_argument(f"--{name}", required=True)
    web.add_argument("--usage")
    web.add_argument("--prompts")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    if args.logs:
        logs.start(args.logs, args.command)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    {"run": _run, "ingest": _ingest, "reindex": _reindex, "web": _web}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
