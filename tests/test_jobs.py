import pytest
from pyspark.sql import functions as F

import compare
from tessella import oracles, prompts, queries
from tessella.operators import geometry, questions, retrieve
from tessella.plans import expressions, seams
from tessella.plans.answer import answer
from tessella.sources import files, sheets, store
from tessella.streaming import jobs

from test_grid import html
from test_table_ops import STATEMENT


@pytest.mark.parametrize("name", ["grid_structure_partial", "header_flatten", "clean_numbers", "op_seq", "op_argmax", "op_colcount", "question_repair", "cosine_topk", "rerank_overlap", "extract_verify", "audit_flags", "usage_rollup", "submission_pad"])
def test_query_agrees_with_sql(spark, small, name):
    compare.agree(spark, queries.QUERIES[name], oracles.SQL[name], small)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.SQL)


def test_answers(spark):
    tables = spark.createDataFrame([("t1", "a.pdf", "利润表", 1, STATEMENT), ("t2", "a.pdf", "名单", 2, html("名称|城市\n甲|京"))], "table_id string, file_name string, table_name string, page int, html string")
    asked = spark.createDataFrame(
        [
            ("1", "a.pdf", "thinking", "利润表中营业成本和总收入相差多少", "利润表", "number", None),
            ("2", "a.pdf", "extract", "甲在哪个城市", "名单", "string", None),
            ("3", "a.pdf", "extract", "甲在哪个城市", "名单", "string", None),
            ("4", "a.pdf", "structure", "恢复第1行的结构", "名单", "json", None),
            ("5", "none.pdf", "thinking", "多少", "", "number", None),
            ("6", "a.pdf", "thinking", "利润表有几项", "利润表", "number", None),
            ("7", "a.pdf", "thinking", "利润表多少", "利润表", "number", None),
        ],
        "question_id string, file_name string, question_type string, question string, table_hint string, answer_format string, format_note string",
    )
    replies = spark.createDataFrame(
        [
            ("1", "op", '```json\n{"op":"diff","a":{"row":"一、营业总收入","col":"本期金额"},"b":{"row":"减：营业成本","col":"本期金额"}}```'),
            ("2", "extract", 'so: {"value": "京"}'),
            ("3", "extract", '{"value": "沪"}'),
            ("6", "op", '{"op":"nonzero","col":"本期金额"}'),
            ("7", "op", "?"),
            ("7", "direct", "1,234"),
        ],
        "question_id string, phase string, reply string",
    )
    got = {r["question_id"]: r for r in answer(asked, tables, replies).collect()}
    assert got["1"]["answer"] == "400" and got["2"]["answer"] == "京" and "extract_unverified" not in got["2"]["events"]
    assert "extract_unverified" in got["3"]["events"] and got["4"]["answer"].startswith('{"row_count": 2, "col_count": 2, "cells": [{"row": 0, "col": 0')
    assert got["5"]["answer"] == "0" and got["5"]["events"] == ["no_table"] and got["5"]["score"] == 0.6
    assert got["6"]["answer"] == "9" and got["7"]["answer"] == "1234" and "sandbox_fail_direct" in got["7"]["events"]


def test_answers_keep_the_cents_of_large_sums(spark):
    tables = spark.createDataFrame([("t", "a.pdf", "表", 1, html("项|1997\n甲|9,876,543,210.12\n乙|2,345,678,901.35"))], "table_id string, file_name string, table_name string, page int, html string")
    asked = spark.createDataFrame([("1", "a.pdf", "thinking", "计算1997年之和，保留2位小数", "", "number", None)], "question_id string, file_name string, question_type string, question string, table_hint string, answer_format string, format_note string")
    replies = spark.createDataFrame([("1", "op", '{"op": "sum", "col": "1997"}')], "question_id string, phase string, reply string")
    assert [r["answer"] for r in answer(asked, tables, replies).collect()] == ["12222222111.47"]


def test_sheet_and_files(spark, tmp_path):
    rows = [["id", "file_name", "question"], ["1", "058.pdf", "a & <b>"], ["2", "", "中"]]
    assert sheets.parse_xlsx(sheets.xlsx_bytes(rows)) == rows
    (tmp_path / "s.xlsx").write_bytes(sheets.xlsx_bytes(rows))
    assert [r["question"] for r in sheets.read_sheet(spark, str(tmp_path / "s.xlsx")).collect()] == ["a & <b>", "中"]
    for name, body in (("a.pdf", b"1"), ("b.png", b"1"), ("c.txt", b"1"), ("d.JPG", b"2")):
        (tmp_path / name).write_bytes(body)
    found = files.deduplicate(files.scan(spark, str(tmp_path))).orderBy("file_name").collect()
    assert [(r["file_name"], r["dedup_of"]) for r in found] == [("a.pdf", None), ("b.png", "a.pdf"), ("d.JPG", None)]
    assert [r["p"] for r in spark.createDataFrame([("58.pdf",), ("0060.pdf",), ("x.pdf",), ("1234.pdf",)], "n string").select(questions.padded_name(F.col("n")).alias("p")).collect()] == ["058.pdf", "060.pdf", None, "1234.pdf"]


def test_store(spark, tmp_path):
    path = str(tmp_path / "tables")
    one = spark.createDataFrame([("f1", "t1", "<table>"), ("f2", "t2", "<table>")], "file_id string, table_id string, html string")
    store.save_tables(one, path, "fp")
    store.save_tables(one.where("file_id = 'f1'").withColumn("table_id", F.lit("t9")), path, "fp2")
    held = store.load_tables(spark, path)
    assert sorted(r["table_id"] for r in held.collect()) == ["t2", "t9"]
    todo = spark.createDataFrame([("f1", None), ("f2", None), ("f3", None), ("f4", "f3")], "file_id string, dedup_of string")
    assert [r["file_id"] for r in store.missing(todo, held, "fp").orderBy("file_id").collect()] == ["f1", "f3"]
    usage = spark.createDataFrame([("b", 1, 2), ("a", 3, 4)], "phase string, input_tokens long, output_tokens long")
    assert store.cost_report(usage).decode("utf-8-sig").split() == ["phase,input_tokens,output_tokens,total_tokens,calls", "a,3,4,7,1", "b,1,2,3,1", "TOTAL,4,6,10,2"]


def test_models_that_fail(spark):
    asked = spark.createDataFrame([("1", "op", "a"), ("2", "op", "bad")], "question_id string, phase string, prompt string")

    def chat(prompt):
        if prompt == "bad":
            raise ValueError("refused")
        return prompt.upper()

    got = {r["question_id"]: r for r in seams.call_model(asked, chat, at_once=2).collect()}
    assert got["1"]["reply"] == "A" and got["2"]["error"] == "refused"
    assert seams.retryable("HTTP 503") and not seams.retryable("refused")
    replies = spark.createDataFrame([("1", "op", "x")], "question_id string, phase string, reply string")
    assert {r["question_id"]: r["reply"] for r in seams.recorded(asked, replies).collect()} == {"1": "x", "2": None}


def test_search_without_file(spark):
    chunks = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [0.0, 0.0])], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, vector array<double>")
    assert [r["chunk_id"] for r in retrieve.search(asked, chunks, by=None).collect()] == ["c1"]


def test_matrix_of_words(spark):
    words = [(0, 0, "注释12"), (20, 0, "a"), (21, 50, "b"), (40, 2, "c"), (41, 49, "d"), (41, 55, "e"), (60, 200, "x")]
    rows = [(1, float(top), float(x), t) for top, x, t in words] + [(2, 0.0, 0.0, "a"), (3, 0.0, 0.0, "a"), (3, 0.0, 9.0, "b"), (4, 0.0, 0.0, "a"), (4, 20.0, 0.0, "b"), (4, 40.0, 0.0, "c")]
    got = {r["page_id"]: r["rows"] for r in geometry.rebuild(spark.createDataFrame(rows, "page_id int, top double, x0 double, text string")).collect()}
    assert got == {1: [["a", "b"], ["c", "de"], ["", ""]], 2: None, 3: None, 4: None}


def test_programs(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 5.0)], "k string, v double")
    got = expressions.compile_program(t, [{"filter": {"col": "v", "op": ">", "value": 1}}, {"agg": {"by": ["k"], "values": {"s": ["sum", "v"]}}}]).collect()
    assert [tuple(r) for r in got] == [("b", 8.0)]
    for bad in ([{"exec": "x"}], [{"select": ["nope"]}], [{"filter": {"col": "v", "op": "like", "value": 1}}]):
        with pytest.raises(expressions.ProgramError):
            expressions.compile_program(t, bad)


def test_prompts():
    assert prompts.render("a {{ x }}", x=1) == "a 1" and len(prompts.fingerprint({"a": "b"})) == 8
    with pytest.raises(KeyError):
        prompts.render("{{ y }}", x=1)


def test_streams(spark, tmp_path):
    pages = str(tmp_path / "pages")
    spark.createDataFrame([("d1", "<table><tr><td>a</td></tr></table>"), ("d2", "none")], "doc_id string, raw string").write.parquet(pages)
    stream = spark.readStream.schema("doc_id string, raw string").parquet(pages)
    jobs.ingest_pages(stream, str(tmp_path / "cells"), str(tmp_path / "cp")).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "cells")).collect()] == ["a"]
    events = str(tmp_path / "events")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS event_type, 1D AS value UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'x', 2D").write.parquet(events)
    live = jobs.usage_windows(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(events))
    q = live.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("SELECT * FROM windows").collect()] == [1]
