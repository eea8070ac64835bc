"""Registered queries of the library, each over whole tables, with the SQL it must agree with."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import format as A
from .operators import geometry, grid, questions, reports, retrieve, table_ops
from .plans.answer import answer
from .scratch import cut
from .sources import files, store
from .streaming import jobs

YEARS = list(range(1995, 2002))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _html(rows: DataFrame, header: list[str]) -> DataFrame:
    """Tables from rows(table_id, ord, cells): the cells of a table are few."""
    head = F.array(*map(F.lit, header))
    body = F.transform(F.array_sort(F.collect_list(F.struct("ord", "cells"))), lambda x: x["cells"])
    return rows.groupBy("table_id").agg(grid.text_html(F.concat(F.array(head), body)).alias("html"))


def _money(c: Column) -> Column:
    """1,234.56 and (1,234.56)."""
    shown = F.call_function("format_number", F.abs(c), F.lit("#,##0.00"))
    return F.when(c < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each nation: order totals by priority and year."""
    orders = _read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    owned = orders.join(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    totals = owned.groupBy(F.col("c_nationkey").cast("string").alias("table_id"), "p").pivot("y", YEARS).agg(F.sum("v"))
    cells = F.array("p", *(F.coalesce(_money(F.col(f"`{y}`")), F.lit("")) for y in YEARS))
    return _html(totals.select("table_id", F.col("p").alias("ord"), cells.alias("cells")), ["优先级", *map(str, YEARS)])


def _typed(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed tables, written for the several joins of an operator that read them."""
    tcols, tcells = grid.typed(cut(grid.parse_cells(tables), "cells"))
    return cut(tcols, "tcols"), cut(tcells, "tcells")


def _ask(spark: SparkSession, sf_dir: str, op: dict) -> DataFrame:
    """One operator over all statements."""
    tables = cut(statements(spark, sf_dir), "statements")
    tcols, tcells = _typed(tables)
    asked = tables.select(F.col("table_id").alias("question_id"), "table_id", F.lit(json.dumps(op, ensure_ascii=False)).alias("op_json"))
    return table_ops.execute(asked, tcols, tcells)


def _number(op: dict):
    return lambda spark, sf_dir: _ask(spark, sf_dir, op).select("question_id", F.round("value.num", 2).alias("num"), "error")


def _text(op: dict):
    return lambda spark, sf_dir: _ask(spark, sf_dir, op).select("question_id", F.col("value.text").alias("text"), "error")


def _listed(op: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = F.array_join(F.transform("items", lambda x: F.when(x["kind"] == "num", X.digits(x["num"], "0.00")).otherwise(x["text"])), "|")
        return _ask(spark, sf_dir, op).select("question_id", shown.alias("listed"), "error")

    return query


def _ref(row: str, col: int) -> dict:
    return {"row": row, "col": str(col)}


URGENT, HIGH, LOW = "1-URGENT", "2-HIGH", "5-LOW"


def op_subitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations listed below a region's heading, in a statement of all regions."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    heads = region.select(F.lit("all").alias("table_id"), F.struct(F.col("r_regionkey").alias("r"), F.lit(-1).alias("n")).alias("ord"), F.array(F.concat("r_name", F.lit("：")), F.lit("")).alias("cells"))
    rows = nation.select(F.lit("all"), F.struct(F.col("n_regionkey"), F.col("n_nationkey")), F.array("n_name", F.col("n_nationkey").cast("string")))
    tcols, tcells = _typed(_html(heads.union(rows), ["项目", "编号"]))
    asked = region.select(F.col("r_name").alias("question_id"), F.lit("all").alias("table_id"), F.to_json(F.struct(F.lit("subitems").alias("op"), F.concat("r_name", F.lit("：")).alias("item"))).alias("op_json"))
    return table_ops.execute(asked, tcols, tcells).select("question_id", F.array_join(F.transform("items", lambda x: x["text"]), "|").alias("listed"), "error")


def op_colcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part type a brand is marked for most often, over size rows."""
    part = _read(spark, sf_dir, "part")
    kinds = part.agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))  # one row: the columns of each table
    held = part.groupBy(F.col("p_brand").alias("table_id"), F.col("p_size").alias("ord")).agg(F.collect_set("p_type").alias("held"))
    marks = F.transform("kinds", lambda k: F.when(F.array_contains("held", k), "✅").otherwise(""))
    rows = held.crossJoin(F.broadcast(kinds)).withColumn("cells", F.concat(F.array(F.concat(F.lit("size "), F.col("ord").cast("string"))), marks))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "cells"))), lambda x: x["cells"])
    whole = F.concat(F.array(F.concat(F.array(F.lit("尺寸")), F.first("kinds"))), lines)
    tables = rows.groupBy("table_id").agg(grid.text_html(whole).alias("html"))
    tcols, tcells = _typed(tables)
    asked = tables.select(F.col("table_id").alias("question_id"), "table_id", F.lit('{"op": "colcount", "match": "✅"}').alias("op_json"))
    return table_ops.execute(asked, tcols, tcells).select("question_id", F.col("value.text").alias("text"), "error")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations in one table, each region's name merged over its rows."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # both are a few dozen names
    rows = named.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    lines = F.transform("n", lambda x, i: F.concat(F.when(i == 0, F.format_string('<tr><td rowspan="%d">%s</td>', F.size("n"), "r_name")).otherwise("<tr>"), F.lit("<td>"), x, F.lit("</td></tr>")))
    body = rows.select("r_name", F.array_join(lines, "").alias("h"))
    whole = body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_name", "h"))), lambda x: x["h"]), "").alias("h"))
    return whole.select(F.lit("regions").alias("table_id"), F.concat(F.lit("TABLE_NAME: regions\n```html\n<table>"), F.col("h"), F.lit("</table>```")).alias("raw"))


def _region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.parse_cells(grid.extract_tables(_regions(spark, sf_dir), id_col="table_id", text_col="raw").where("table_name = 'regions'"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_cells(spark, sf_dir).select("row", "col", "text", "rowspan", "is_anchor")


def grid_structure_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _region_cells(spark, sf_dir)
    asked = spark.createDataFrame([("regions", "恢复第1行和第1列的表格结构")], "table_id string, question string").withColumn("r", questions.parse_range(F.col("question")))
    return grid.structure_json(cells, asked.select("table_id", "r.row_lo", "r.row_hi", "r.col_lo", "r.col_hi"))


def grid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = grid.parse_cells(grid.grid_html(_region_cells(spark, sf_dir)))
    return again.groupBy("row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("region"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("nation"))


def frame_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    tcols, tcells = grid.typed(grid.parse_cells(statements(spark, sf_dir)))
    return tcells.where("c > 0").join(tcols, ["table_id", "c"]).groupBy("table_id", "col_name").agg(F.count_if(F.col("kind") == "num").alias("numbers"), F.sum(F.col("num").cast("decimal(38,2)")).cast("double").alias("total"))


def header_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level headers: by nation, the totals of two years under one merged heading, with a repeated name."""
    flat = grid.parse_cells(statements(spark, sf_dir))
    texts = flat.groupBy("table_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("t")).where("pos > 0")
    line = F.format_string("<tr><td>%s</td><td>%s</td><td>%s</td><td>%s</td></tr>", F.col("t")[0], F.col("t")[1], F.col("t")[2], F.col("t")[1])
    body = texts.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("h")))), lambda x: x["h"]), "").alias("h"))
    top = "<table><tr><th rowspan=2>项目</th><th colspan=3>金额</th></tr><tr><th>上期</th><th>本期</th><th>上期</th></tr>"
    tables = body.select("table_id", F.concat(F.lit(top), F.col("h"), F.lit("</table>")).alias("html"))
    tcols, tcells = grid.typed(grid.parse_cells(tables))
    return tcells.join(tcols, ["table_id", "c"]).where("c > 0").groupBy("table_id", "col_name").agg(F.sum(F.col("num").cast("decimal(38,2)")).cast("double").alias("total"))


def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances of a nation's customers read back from a table with parentheses and grouping."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("table_id"), F.col("c_custkey").alias("ord"), F.array(F.col("c_custkey").cast("string"), F.concat(F.lit("　"), _money(F.round("c_acctbal", 2)))).alias("cells"))
    _, tcells = grid.typed(grid.parse_cells(_html(c, ["客户", "余额（元）"])))
    value = lambda i: F.max(F.when(F.col("c") == i, F.col("num")))
    return tcells.groupBy("table_id", "r").agg(value(0).cast("long").alias("c_custkey"), value(1).alias("balance")).select("c_custkey", "balance")


def unit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    unit = F.element_at(F.array(*map(F.lit, ["元", "万元", "千元"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    html = F.concat(F.lit("<table><tr><td>"), F.col("s_name"), F.lit("</td><td>单位： "), unit, F.lit("</td></tr><tr><td>a</td><td></td></tr></table>"))
    return grid.table_facts(grid.parse_cells(s.select(F.col("s_suppkey").cast("string").alias("table_id"), html.alias("html")))).select("table_id", "unit_note", "n_rows", "n_cols", "has_data", "masked")


def format_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    said = F.concat(F.lit("约 ￥"), _money(F.round("c_acctbal", 2)))
    v = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("is_int"), F.regexp_replace(said, r"约 ￥\(", "(").alias("text")).cast(A.VALUE)
    return c.select("c_custkey", A.format_answer(v, F.lit(None).cast(f"array<{A.VALUE}>"), F.lit("number"), F.lit(None).cast("int"), F.lit("多少")).alias("answer"))


def format_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    text = lambda t: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("is_int"), t.alias("text")).cast(A.VALUE)
    items = F.array(text(F.col("o_orderpriority")), text(F.col("o_orderkey").cast("string")), text(F.lit("")), text(F.concat(F.lit("0"), F.col("o_custkey").cast("string"))))
    asked = F.when(F.col("o_orderkey") % 2 == 0, "列出所有值").otherwise("以下字段依次是什么")
    return o.select("o_orderkey", A.format_array(items, asked).alias("answer"))


def format_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('["'), F.col("p_name"), F.lit('"]'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.col("p_brand"), F.lit("　　"), F.col("p_name"))).otherwise(F.call_function("format_number", F.col("p_partkey") * 1000, F.lit("#,##0")))
    v = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("is_int"), text.alias("text")).cast(A.VALUE)
    return p.select("p_partkey", A.format_string(v, F.lit(None).cast(f"array<{A.VALUE}>"), F.lit("名称")).alias("answer"))


def compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("、", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"))).otherwise(F.lit("1,234"))
    return o.select("o_orderkey", F.array_join(A.split_compound(said, F.lit("以下字段分别是")), "|").alias("parts"))


def question_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet made from orders: repeated ids, unpadded file names, missing files, invalid types and free formats."""
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (k % by % len(values) + 1).cast("int"))
    sheet = o.select(
        k.alias("row_no"),
        F.concat(F.lit("q"), (k - k % 11 % 2).cast("string")).alias("id"),
        F.concat((k % 120).cast("string"), F.lit(".pdf")).alias("file_name"),
        pick(["extract", "thinking", "??"], 97).alias("question_type"),
        pick(["计算总和", "恢复表格结构", "名称是什么", ""], 89).alias("question"),
        F.lit("").alias("table_hint"),
        pick(["string", "json", "JSON数组", "百分比，保留一位小数", "填写名称"], 83).alias("answer_format"),
    )
    known = spark.range(100).select(F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(".pdf")).alias("file_name"))
    good, skipped = questions.clean(sheet, known)
    kept = good.select("row_no", F.col("question_id").alias("id"), "file_name", "question_type", "answer_format", F.lit("").alias("reason"))
    return kept.union(skipped.select("row_no", "id", F.lit(""), F.lit(""), F.lit(""), "reason"))


def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (k % 30 + 1).cast("string")
    asked = F.when(k % 4 == 0, F.concat(F.lit("恢复前"), n, F.lit("行和第 2 列"))).when(k % 4 == 1, F.concat(F.lit("恢复第"), n, F.lit("页的表格"))).when(k % 4 == 2, F.concat(F.lit("第"), n, F.lit("行的结构"))).otherwise("恢复表头行结构")
    return _read(spark, sf_dir, "orders").select("o_orderkey", questions.parse_range(asked).alias("r")).select("o_orderkey", "r.*")


def tokens_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.let(X.tokens(F.col("text")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.sha2(F.array_join(F.array_sort(t), " "), 256).alias("digest")))
    return _read(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.n", "x.digest")


def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", X.expand_query(F.concat(F.col("p_brand"), F.lit("的"), F.col("p_name"), F.lit("，多少？"))).alias("q"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of the same label for every vector whose id is divisible by 100."""
    e = _read(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("file_id"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("file_id"))
    return retrieve.search(asked, chunks, least=-1.0).select("query_id", "chunk_id", "rank", F.round("similarity", 4).alias("similarity"))


def directed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a bound that nothing else reaches: each query keeps its nearest."""
    e = _read(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("file_id"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("file_id"))
    return retrieve.search(asked, chunks, least=2.0).select("query_id", "chunk_id", "directed")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's sizes as chunks whose header lists the types of their parts; queries ask for a type of a brand."""
    part = _read(spark, sf_dir, "part")
    heads = part.groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_set("p_type")).alias("h"))
    chunks = heads.select("p_brand", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("chunk_id"), F.concat(F.lit("表名: -\n表头: "), F.array_join("h", " | ")).alias("chunk_text"), (F.col("p_size") / 100).alias("similarity"))
    asked = part.select("p_brand", F.concat_ws(" ", "p_brand", "p_type").alias("query_id"), F.col("p_type").alias("question")).distinct()
    ranked = asked.join(chunks, "p_brand").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return retrieve.rerank(ranked).select("query_id", "chunk_id", "place", "rerank_bonus", "adjusted_score")


def extract_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances claimed for a nation, right for even customer keys, against the nation's table."""
    c = _read(spark, sf_dir, "customer").withColumn("b", F.round("c_acctbal", 2))
    rows = c.select(F.col("c_nationkey").cast("string").alias("table_id"), F.col("c_custkey").alias("ord"), F.array("c_name", F.call_function("format_number", F.col("b"), F.lit("#,##0.00"))).alias("cells"))
    cells = grid.parse_cells(_html(rows, ["客户", "余额"]))
    claim = F.call_function("format_number", F.when(F.col("c_custkey") % 2 == 0, F.col("b")).otherwise(F.col("b") + 100000), F.lit("0.00"))
    values = c.select(F.col("c_custkey").cast("string").alias("question_id"), F.col("c_nationkey").cast("string").alias("table_id"), F.array("c_name", claim).alias("items"))
    return retrieve.verify_extract(values, cells)


def dedup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", F.format_string("%09d.pdf", "doc_id").alias("file_name"), files.file_id(F.col("text").cast("binary")).alias("file_id"))
    return files.deduplicate(d).select("doc_id", "file_id", "dedup_of")


def garbled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", X.garbled(F.col("text")).alias("garbled"), X.garbled_layer(F.col("text")).alias("garbled_layer"))


def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("event", F.when(F.col("event_id") % 5 == 0, "no_table").when(F.col("event_id") % 5 == 1, "extract_unverified").otherwise(F.col("event_type")))
    by = e.groupBy("user_id", F.floor(F.col("event_id") / 500).alias("block")).agg(F.collect_list("event").alias("events"))
    score = A.confidence_score(F.col("events"))
    return by.select("user_id", "block", score.alias("score"), A.confidence(score).alias("confidence"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.when(k % 7 == 0, "").when(k % 7 == 1, "数据未提供").when(k % 7 == 2, "nan").when(k % 7 == 3, '[null, ""]').otherwise(k.cast("string"))
    return o.select(k.cast("string").alias("question_id"), "o_orderpriority", F.concat((k % 50).cast("string"), F.lit(".pdf")).alias("file_name"), text.alias("answer"), (k % 10 / 10).alias("score"), F.when(k % 3 == 0, "rag_miss;no_table").when(k % 3 == 1, "rag_miss").otherwise("").alias("events"))


def validity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.class_counts(_answers(spark, sf_dir).withColumn("class", reports.validity(F.col("answer"))), "o_orderpriority")


def cause_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.causes(_answers(spark, sf_dir))


def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.file_rollup(_answers(spark, sf_dir).withColumn("class", reports.validity(F.col("answer"))))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.event_files(_answers(spark, sf_dir), "no_table")


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return reports.usage_summary(e.select(F.col("event_type").alias("phase"), F.floor(F.abs("value")).cast("long").alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens")))


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jobs.usage_windows(_read(spark, sf_dir, "events").withColumn("value", F.col("event_id").cast("double")))
    return made.select(F.unix_timestamp("window_start").alias("start_s"), "event_type", "n", "total")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = jobs.sessions(_read(spark, sf_dir, "events"))
    return made.select("user_id", F.unix_timestamp("session_start").alias("start_s"), "n")


def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = o.select(
        k.cast("string").alias("question_id"),
        pick(["金额是多少", "是否盈利", "列出所有名称", "比例是多少", "有几个项目"]).alias("question"),
        F.when(k % 5 == 2, "json_array").otherwise("string").alias("answer_format"),
        F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "[MASK]").otherwise('["x", "x"]').alias("answer"),
        F.lit("").alias("events"),
        F.lit(None).cast("int").alias("most_rows"),
    )
    return reports.audit(rows).select("question_id", F.array_join(F.array_sort("flags"), ",").alias("flags"), "n_flags")


def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _answers(spark, sf_dir)
    value = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("is_int"), F.col("answer").alias("text")).cast(A.VALUE)
    after = before.select("question_id", A.or_empty(A.format_number(value), F.lit("number")).alias("answer"))
    return reports.replay(before, after).groupBy("changed").agg(F.count("*").alias("n"))


def submission_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    skipped = a.select((F.col("question_id").cast("long") * 2).cast("string").alias("id"), F.lit("missing file").alias("reason"))
    return store.submission(a, skipped).select("id", "answer", "part")


def nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words at heights of line items assigned to rows 20 points apart, within 8 points."""
    li = _read(spark, sf_dir, "lineitem")
    words = li.select(F.col("l_suppkey").alias("page_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias("word_id"), (F.col("l_quantity") * 7.25).alias("top"), (F.col("l_quantity") * 7.25).alias("bottom"))
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("row_no")).withColumn("top", F.col("row_no") * 20.0).withColumn("bottom", F.col("row_no") * 20.0)
    return geometry.nearest_rows(words, rows, 8.0).groupBy("page_id", "row_no").agg(F.count("*").alias("n"))


def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole job: a counting, an extreme and a structure question on every nation's statement."""
    tables = cut(statements(spark, sf_dir), "statements").select("table_id", F.concat("table_id", F.lit(".pdf")).alias("file_name"), F.concat(F.lit("statement "), F.col("table_id")).alias("table_name"), F.lit(1).alias("page"), "html")
    kinds = [("max", "thinking", "1997年最高的优先级", "string", '{"op": "argmax", "col": "1997"}'), ("sum", "thinking", "计算1997年之和，保留2位小数", "number", '{"op": "sum", "col": "1997"}'), ("top", "structure", "恢复第1行的结构", "json", None)]
    names = ["k", "question_type", "question", "answer_format", "op"]
    three = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, kind))) for kind in kinds))
    asked = tables.select("table_id", "file_name", F.explode(three).alias("q")).select("table_id", "file_name", "q.*")
    asked = asked.withColumn("question_id", F.concat_ws("-", "table_id", "k")).withColumn("table_hint", F.lit("")).withColumn("format_note", F.lit(None).cast("string"))
    replies = asked.where("op IS NOT NULL").select("question_id", F.lit("op").alias("phase"), F.col("op").alias("reply"))
    return answer(asked, tables, replies).select("question_id", "answer", "score", "confidence")


QUERIES = {
    "grid_cells": grid_cells,
    "grid_structure_partial": grid_structure_partial,
    "grid_roundtrip": grid_roundtrip,
    "frame_types": frame_types,
    "header_flatten": header_flatten,
    "clean_numbers": clean_numbers,
    "unit_notes": unit_notes,
    "op_const": _number({"op": "const", "value": 7}),
    "op_cell": _number({"op": "cell", **_ref(HIGH, 1996)}),
    "op_cells": _listed({"op": "cells", "refs": [_ref(LOW, 1998), _ref("URGENT", 1995)]}),
    "op_diff": _number({"op": "diff", "a": _ref(URGENT, 1999), "b": _ref(LOW, 1999)}),
    "op_sum": _number({"op": "sum", "col": "1997"}),
    "op_sum_rows": _number({"op": "sum", "col": "1997", "rows": [HIGH, LOW, HIGH]}),
    "op_avg": _number({"op": "avg", "col": "1997"}),
    "op_ratio_sum": _number({"op": "ratio_sum", "num_col": "1996", "den_col": "1997", "rows": [URGENT, HIGH]}),
    "op_count": _number({"op": "count"}),
    "op_contains": _text({"op": "contains", "text": "URGENT"}),
    "op_argmax": _text({"op": "argmax", "col": "1997"}),
    "op_argmin": _text({"op": "argmin", "col": "1997"}),
    "op_rowmax": _text({"op": "rowmax", "row": HIGH}),
    "op_rowmin": _text({"op": "rowmin", "row": HIGH}),
    "op_nonzero": _listed({"op": "nonzero", "col": "1998", "after_row": HIGH}),
    "op_seq": _listed({"op": "seq", "ops": [{"op": "sum", "col": "1995"}, {"op": "seq", "ops": [{"op": "cell", **_ref(LOW, 1996)}]}]}),
    "op_subitems": op_subitems,
    "op_colcount": op_colcount,
    "answer_batch": answer_batch,
    "format_numbers": format_numbers,
    "format_arrays": format_arrays,
    "format_strings": format_strings,
    "compound_split": compound_split,
    "question_repair": question_repair,
    "range_parse": range_parse,
    "tokens_select": tokens_select,
    "query_expand": query_expand,
    "cosine_topk": cosine_topk,
    "directed_fallback": directed_fallback,
    "rerank_overlap": rerank_overlap,
    "extract_verify": extract_verify,
    "dedup_files": dedup_files,
    "garbled_text": garbled_text,
    "confidence_scores": confidence_scores,
    "validity_class": validity_class,
    "cause_rollup": cause_rollup,
    "file_rollup": file_rollup,
    "event_files": event_files,
    "usage_rollup": usage_rollup,
    "usage_windows": usage_windows,
    "user_sessions": user_sessions,
    "audit_flags": audit_flags,
    "replay_diff": replay_diff,
    "submission_pad": submission_pad,
    "nearest_lines": nearest_lines,
}
