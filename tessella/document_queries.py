"""Registered queries of pages, stores, texts and records, each with its DuckDB SQL beside it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prompts
from .functions import similarity as S
from .functions import text as X
from .operators import format as A
from .operators import geometry, grid, questions, reports, retrieve, table_ops
from .plans import answer as plan
from .plans import expressions, ingest, pages, seams
from .plans import report as quality
from .queries import _answers, _html, _read, _typed, statements
from .scratch import cut, shared_dir
from .sources import files, sheets, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name with the SQL it must agree with."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _pick(values: list[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


# --- questions --------------------------------------------------------------------------------


@query("""SELECT CAST(o_orderkey % 50 AS VARCHAR) || '.pdf' AS file_name, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1""")
def questions_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _answers(spark, sf_dir).withColumn("row_no", F.col("question_id").cast("long"))
    return questions.by_file(asked).select("file_name", "n", F.array_join("question_ids", ",").alias("ids"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 100 AS f, ['extract', '??'][o_orderkey % 97 % 2 + 1] AS t,
  ['string', 'json', 'JSON数组', '保留一位小数', ' 填写名称 '][o_orderkey % 83 % 5 + 1] AS a FROM orders)
SELECT k AS row_no, CASE WHEN a NOT IN ('string', 'json') THEN trim(a) END AS format_note,
  'file_name:' || f || '.pdf' || CASE WHEN t = '??' THEN ',question_type' ELSE '' END || CASE WHEN a NOT IN ('string', 'json') THEN ',answer_format' ELSE '' END AS repaired FROM o""")
def question_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a format said beyond its enumeration, and the repairs of a sheet."""
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    sheet = o.select(
        k.alias("row_no"), k.cast("string").alias("id"), F.concat((k % 100).cast("string"), F.lit(".pdf")).alias("file_name"), _pick(["extract", "??"], k % 97).alias("question_type"),
        F.lit("名称").alias("question"), F.lit("").alias("table_hint"), _pick(["string", "json", "JSON数组", "保留一位小数", " 填写名称 "], k % 83).alias("answer_format"),
    )
    known = spark.range(100).select(F.concat(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(".pdf")).alias("file_name"))
    good, _ = questions.clean(sheet, known)
    return good.select("row_no", "format_note", F.array_join("repaired", ",").alias("repaired"))


_NUMERAL = """CASE WHEN n < 10 THEN d[n] WHEN n = 10 THEN '十' WHEN n < 20 THEN '十' || d[n - 10] ELSE d[n // 10] || '十' || CASE WHEN n % 10 = 0 THEN '' ELSE d[n % 10] END END"""


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 60 + 1 AS INTEGER) AS n FROM orders)
SELECT k AS o_orderkey, CASE k % 5 WHEN 3 THEN n END AS page_lo, CASE k % 5 WHEN 3 THEN n + 1 END AS page_hi,
  CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN n - 1 END AS row_lo, CASE k % 5 WHEN 0 THEN n - 1 WHEN 1 THEN n END AS row_hi,
  CASE k % 5 WHEN 2 THEN n - 1 END AS col_lo, CASE k % 5 WHEN 2 THEN n - 1 END AS col_hi, CASE k % 5 WHEN 4 THEN 'full' ELSE 'regex' END AS how FROM o""")
def range_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges in Chinese numerals, spans of rows and of pages, and questions without a range."""
    k = F.col("o_orderkey")
    digit = lambda i: F.element_at(F.array(*map(F.lit, "一二三四五六七八九")), i.cast("int"))
    tens = lambda n: F.concat(F.when(n < 20, "").otherwise(digit(F.greatest(F.floor(n / 10), F.lit(1)))), F.lit("十"), F.when(n % 10 == 0, "").otherwise(digit(F.greatest(n % 10, F.lit(1)))))
    name = lambda n: F.when(n < 10, digit(F.least(n, F.lit(9)))).otherwise(tens(n))
    n = k % 60 + 1
    asked = (
        F.when(k % 5 == 0, F.concat(F.lit("恢复前 "), name(n), F.lit(" 行")))
        .when(k % 5 == 1, F.concat(F.lit("第"), name(n), F.lit("行到第"), name(n + 1), F.lit("行的结构")))
        .when(k % 5 == 2, F.concat(F.lit("恢复第"), name(n), F.lit("列")))
        .when(k % 5 == 3, F.concat(F.lit("第"), n.cast("string"), F.lit("页至"), (n + 1).cast("string"), F.lit("页的表格")))
        .otherwise("恢复整张表")
    )
    return _read(spark, sf_dir, "orders").select("o_orderkey", questions.parse_range(asked).alias("r")).select("o_orderkey", "r.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(1 + o_orderkey % 3 AS INTEGER) END AS page_lo, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 9 + 4 AS INTEGER) END AS page_hi,
  CASE o_orderkey % 4 WHEN 1 THEN 0 END AS row_lo, CASE o_orderkey % 4 WHEN 1 THEN CAST(o_orderkey % 9 AS INTEGER) END AS row_hi, CAST(NULL AS INTEGER) AS col_lo, CAST(NULL AS INTEGER) AS col_hi,
  CASE WHEN o_orderkey % 4 < 3 THEN 'llm' ELSE 'fallback_full' END AS how FROM orders""")
def range_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges as a model says them: pages, rows, none, and no JSON at all."""
    k = F.col("o_orderkey")
    said = (
        F.when(k % 4 == 0, F.format_string('so: {"page_range": [%d, %d], "row_range": null}', 1 + k % 3, k % 9 + 4))
        .when(k % 4 == 1, F.format_string('```json\n{"row_range": [0, %d], "col_range": []}```', k % 9))
        .when(k % 4 == 2, "{}")
        .otherwise("the whole table")
    )
    return _read(spark, sf_dir, "orders").select("o_orderkey", questions.range_from_json(said).alias("r")).select("o_orderkey", "r.*")


# --- texts ------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_size BETWEEN 3 AND 40 AND p_partkey % 2 = 0 AS year, 'a' || p_brand || 'b' AS compact, '{"k": ' || p_partkey || '}' AS object, 'x' || p_partkey AS fenced,
  p_partkey % 3 = 0 AS leak, p_partkey % 5 = 0 AS missing_noun, p_partkey % 7 = 0 AS vertical, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS places, p_partkey % 6 < 2 AS blank FROM part""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on texts: years, compact names, JSON in prose, fences, markup, quoted nouns, vertical text, precision and blanks."""
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, "保留2位小数").when(k % 4 == 2, "多少").otherwise("")
    note = F.when(k % 4 == 1, "数字，保留三位小数").otherwise(None)
    blank = F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 1, " 　\n").otherwise("v")
    year = F.when(k % 2 == 0, (F.col("p_size") + 1897 + F.when(F.col("p_size") > 40, 200).otherwise(0)).cast("string")).otherwise(F.concat(F.lit("y"), F.col("p_size").cast("string")))
    year = F.when((k % 2 == 0) & (F.col("p_size") < 3), "1899").otherwise(year)
    return _read(spark, sf_dir, "part").select(
        "p_partkey",
        X.year_like(F.lit("text"), F.lit(None).cast("double"), year).alias("year"),
        X.compact(F.concat(F.lit(" a“"), F.col("p_brand"), F.lit("”\t「b」"))).alias("compact"),
        X.json_object(F.concat(F.lit("so\n{"), F.lit('"k": '), k.cast("string"), F.lit("} there"))).alias("object"),
        X.strip_fence(F.concat(F.lit("```json\nx"), k.cast("string"), F.lit("\n```"))).alias("fenced"),
        X.markup_leak(F.when(k % 3 == 0, 'ColumnSpan="2" x').otherwise("Span 2")).alias("leak"),
        X.nouns_missing(F.concat(F.lit("“"), F.col("p_brand"), F.lit("”是多少")), F.when(k % 5 == 0, F.lit("<td>none</td>")).otherwise(F.concat(F.lit("<td>"), F.col("p_brand"), F.lit("</td>")))).alias("missing_noun"),
        X.vertical(F.when(k % 7 == 0, "竖排文字").otherwise("横排文字")).alias("vertical"),
        X.precision(said, note).alias("places"),
        X.value_missing(blank).alias("blank"),
    )


@query("""SELECT p_partkey, round(200.0 * length(p_brand) / (2 * length(p_brand) + 4), 6) AS longer, CAST(0 AS DOUBLE) AS apart, CAST(100 AS DOUBLE) AS inside,
  round(200.0 * (length(p_brand) - 1) / (2 * length(p_brand) - 1), 6) AS shorter FROM part""")
def fuzzy_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit ratios of texts whose common parts are known."""
    b = F.col("p_brand")
    made = [S.ratio(b, F.concat(b, F.lit("一二三四"))).alias("longer"), S.ratio(b, F.lit("甲乙丙")).alias("apart"), S.partial_ratio(b, F.concat(F.lit("甲乙"), b, F.lit("丙"))).alias("inside"), S.ratio(b, F.substr(b, F.lit(2), F.lit(99))).alias("shorter")]
    return _read(spark, sf_dir, "part").select("p_partkey", *made).select("p_partkey", *(F.round(c, 6).alias(c) for c in ("longer", "apart", "inside", "shorter")))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'num' WHEN 1 THEN 'list' WHEN 2 THEN 'list' ELSE 'text' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey * 1000 AS VARCHAR) WHEN 1 THEN o_orderpriority || '|7' WHEN 2 THEN o_orderstatus || '|' || o_orderpriority ELSE '大约' || o_orderstatus END AS said FROM orders""")
def direct_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct answers of a model: a number, a JSON list, the parts of a compound answer, or a text."""
    k = F.col("o_orderkey")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), F.call_function("format_number", k * 1000, F.lit("#,##0"))))
        .when(k % 4 == 1, F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", 7]')))
        .when(k % 4 == 2, F.concat_ws("、", "o_orderstatus", "o_orderpriority"))
        .otherwise(F.concat(F.lit("大约"), F.col("o_orderstatus")))
    )
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", plan.direct_value(said, F.lit("以下字段分别是什么")).alias("d")).select("o_orderkey", "d.*")
    shown = lambda v: F.when(v["kind"] == "num", X.digits(v["num"], "0.##")).otherwise(v["text"])
    kind = F.when(F.col("items").isNotNull(), "list").otherwise(F.col("value.kind"))
    return rows.select("o_orderkey", kind.alias("kind"), F.when(F.col("items").isNotNull(), F.array_join(F.transform("items", shown), "|")).otherwise(shown(F.col("value"))).alias("said"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS DOUBLE) END AS safe FROM customer""")
def json_safe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that JSON can carry; the others are null."""
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, k.cast("double")).when(k % 3 == 1, F.lit(float("nan"))).otherwise(F.when(k % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    return _read(spark, sf_dir, "customer").select("c_custkey", X.json_safe(value).alias("safe"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a": [1, "' || p_brand || '"]}' WHEN 1 THEN '["' || p_brand || '", 2.5]' ELSE CAST(p_partkey AS VARCHAR) END AS answer FROM part""")
def format_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as JSON texts: an object that is one already, a list, a number."""
    k = F.col("p_partkey")
    null = F.lit(None)
    made = lambda kind, num, text: F.struct(F.lit(kind).alias("kind"), num.cast("double").alias("num"), null.cast("boolean").alias("is_int"), text.cast("string").alias("text")).cast(A.VALUE)
    value = F.when(k % 3 == 0, made("text", null, F.concat(F.lit('{"a": [1, "'), F.col("p_brand"), F.lit('"]}')))).when(k % 3 == 2, made("num", k, null))
    items = F.when(k % 3 == 1, F.array(made("text", null, F.col("p_brand")), made("num", F.lit(2.5), null)))
    rows = _read(spark, sf_dir, "part").select("p_partkey", value.alias("v"), items.alias("i"))
    return rows.select("p_partkey", A.format_answer(F.col("v"), F.col("i"), F.lit("json"), F.lit(None).cast("int"), F.lit("结构")).alias("answer"))


# --- tables -----------------------------------------------------------------------------------

_MONEY = """s AS (SELECT CAST(c_nationkey AS VARCHAR) AS question_id, o_orderpriority AS p, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), q AS (SELECT DISTINCT question_id FROM s)"""


def _asked(tables: DataFrame, op: dict) -> DataFrame:
    tables = cut(tables, "asked")
    tcols, tcells = _typed(tables)
    return table_ops.execute(tables.select(F.col("table_id").alias("question_id"), "table_id", F.lit(json.dumps(op, ensure_ascii=False)).alias("op_json")), tcols, tcells)


@query(f"""WITH {_MONEY} SELECT question_id, nullif(CAST((SELECT count(DISTINCT p) FROM s WHERE s.question_id = q.question_id AND contains(p, 'I')) AS DOUBLE), 0) AS num,
  CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.question_id = q.question_id AND contains(p, 'I')) THEN 'nothing matches: I' END AS error FROM q""")
def op_count_needle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose first cell holds a text."""
    return _asked(statements(spark, sf_dir), {"op": "count", "contains": "I"}).select("question_id", "value.num", "error")


@query(f"""WITH {_MONEY} SELECT question_id, (SELECT CAST(y AS VARCHAR) FROM s WHERE s.question_id = q.question_id AND p = '3-MEDIUM' ORDER BY v DESC, y LIMIT 1) AS text,
  CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.question_id = q.question_id AND p = '3-MEDIUM') THEN 'row not found' END AS error FROM q""")
def op_rowmax_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest column of a row, named by the row of years below headings that say nothing."""
    cells = grid.parse_cells(statements(spark, sf_dir))
    rows = cells.groupBy("table_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))
    rows = rows.withColumn("cells", F.when(F.col("pos") == 0, F.concat(F.array(F.lit("年度")), F.slice("cells", 2, 99))).otherwise(F.col("cells")))
    tables = _html(rows.select("table_id", F.col("pos").alias("ord"), "cells"), ["项目", *(f"P.{i}" for i in range(7))])
    return _asked(tables, {"op": "rowmax", "row": "3-MEDIUM"}).select("question_id", F.col("value.text").alias("text"), "error")


@query("""SELECT r_name AS question_id, string_agg(n_name, '|' ORDER BY n_nationkey) AS listed, CAST(NULL AS VARCHAR) AS error FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def op_subitems_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a zone: each region has a value, and its nations follow under the region's note."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("least"))
    note = lambda c: F.concat(F.lit("注"), c.cast("string"))
    heads = region.select(F.lit("all").alias("table_id"), F.struct(F.col("r_regionkey").alias("r"), F.lit(-1).alias("n")).alias("ord"), F.array(F.col("r_name"), F.lit("甲"), F.lit("1")).alias("cells"))
    named = nation.join(first, "n_regionkey")
    text = F.when(F.col("n_nationkey") == F.col("least"), F.concat(F.lit("其中："), F.col("n_name"))).otherwise(F.col("n_name"))
    rows = named.select(F.lit("all"), F.struct(F.col("n_regionkey"), F.col("n_nationkey")), F.array(text, note(F.col("n_regionkey")), (F.col("n_nationkey") + 1).cast("string")))
    tcols, tcells = _typed(_html(heads.union(rows), ["项目", "附注", "金额"]))
    asked = region.select(F.col("r_name").alias("question_id"), F.lit("all").alias("table_id"), F.to_json(F.struct(F.lit("subitems").alias("op"), F.col("r_name").alias("item"))).alias("op_json"))
    return table_ops.execute(asked, tcols, tcells).select("question_id", F.array_join(F.transform("items", lambda x: x["text"]), "|").alias("listed"), "error")


@query(f"""WITH {_MONEY} SELECT question_id, CASE WHEN CAST(question_id AS INTEGER) % 2 = 0 THEN 'unknown op: teleport' ELSE 'no operator' END AS error FROM q""")
def op_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators that do not exist and replies that hold none are errors of their row."""
    tables = cut(statements(spark, sf_dir), "asked")
    tcols, tcells = _typed(tables)
    said = F.when(F.col("table_id").cast("int") % 2 == 0, '```json\n{"op": "teleport"}\n```').otherwise("I can't say")
    got = table_ops.execute(tables.select(F.col("table_id").alias("question_id"), "table_id", said.alias("op_json")), tcols, tcells)
    return got.select("question_id", F.when(F.contains("error", F.lit("teleport")), "unknown op: teleport").when(F.col("error").isNotNull(), "no operator").alias("error"))


@query(f"""WITH {_MONEY} SELECT question_id AS table_id, p, CAST(v AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY v DESC, p) AS k FROM s WHERE y = 1996 AND v > 1000) WHERE k <= 2""")
def verb_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of verbs over all statements at once: filter, sort, head."""
    tcols, tcells = _typed(statements(spark, sf_dir))
    steps = [{"filter": {"col": "1996", "op": ">", "value": 1000}}, {"sort": ["-1996", "优先级"]}, {"head": 2}, {"select": ["优先级", "1996"]}]
    asked = tcols.select("table_id").distinct().select(F.col("table_id").alias("question_id"), "table_id", F.lit(json.dumps(steps, ensure_ascii=False)).alias("program"))
    got = expressions.run_programs(tcells, tcols, asked)
    return got.select(F.col("question_id").alias("table_id"), F.element_at("row", F.lit("优先级")).alias("p"), F.element_at("row", F.lit("1996")).cast("double").alias("v"))


# --- pages of words ---------------------------------------------------------------------------


@query("""SELECT s_suppkey AS table_id, CASE s_suppkey % 4 WHEN 0 THEN '1．' || s_name WHEN 1 THEN s_name END AS title FROM supplier""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles above tables: a numbered line, the lowest line, and lines that are none."""
    s, k = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    lines = F.array(
        F.struct(F.lit(70.0).alias("top"), F.when(k % 4 == 0, F.concat(F.lit("1．"), F.col("s_name"))).otherwise("附").alias("text")),
        F.struct(F.lit(90.0).alias("top"), F.when(k % 4 == 1, F.concat(F.lit(" "), F.col("s_name"))).when(k % 4 == 2, "期末余额").otherwise("注：以上").alias("text")),
        F.struct(F.lit(10.0).alias("top"), F.lit("9．far away").alias("text")),
    )
    rows = s.select(k.alias("table_id"), F.explode(lines).alias("l")).select("table_id", "l.*", F.lit(100.0).alias("table_top"))
    return geometry.title(rows)


@query("""SELECT s_suppkey AS page_id, 'left' AS side, i AS row_no, 'w' || i AS text FROM supplier, range(4) r(i) WHERE s_suppkey % 2 = 0""")
def side_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of a table that belong to its rows; a single word beside it is no column."""
    s, k = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = s.select(k.alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row_no")).withColumn("top", F.col("row_no") * 20.0).withColumn("bottom", F.col("top") + 10)
    word = lambda i: F.struct(i.alias("word_id"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("x1"), (i * 20.0 + 1).alias("top"), (i * 20.0 + 9).alias("bottom"), F.concat(F.lit("w"), i.cast("string")).alias("text"))
    words = s.select(k.alias("page_id"), F.explode(F.transform(F.sequence(F.lit(0), F.when(k % 2 == 0, 3).otherwise(0)), word)).alias("w")).select("page_id", "w.*")
    return geometry.side_columns(words, rows, 10.0, 100.0).select("page_id", "side", F.col("row_no").cast("long").alias("row_no"), "text")


@query("""SELECT s_suppkey AS page_id, '项目,本期;' || s_name || '甲,' || s_suppkey || ';,9' AS rows FROM supplier""")
def words_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without lines made anew from words: bands, columns of the first band, joined names, no notes."""
    s, k = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    word = lambda top, x, text: F.struct(F.lit(top).alias("top"), F.lit(x).alias("x0"), text.alias("text"))
    words = F.array(
        word(0.0, 0.0, F.lit("注释12")), word(20.0, 0.0, F.lit("项目")), word(20.5, 200.0, F.lit("本期")), word(40.0, 1.0, F.col("s_name")), word(46.0, 2.0, F.lit("甲")),
        word(44.0, 210.0, k.cast("string")), word(60.0, 190.0, F.lit("9")), word(60.0, 320.0, F.lit("stray")),
    )
    rows = s.select(k.alias("page_id"), F.explode(words).alias("w")).select("page_id", "w.*")
    return geometry.rebuild(rows).select("page_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


@query("""SELECT s_suppkey AS page_id, CAST(i AS INTEGER) AS col_no, CASE i WHEN 0 THEN s_name || ' x' WHEN 1 THEN CAST(s_suppkey AS VARCHAR) END AS text FROM supplier, range(3) r(i)""")
def words_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between two heights, each in its nearest column; a column without words is null."""
    s, k = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    word = lambda i, top, x, text: F.struct(F.lit(i).alias("word_id"), F.lit(top).alias("top"), F.lit(top + 8).alias("bottom"), F.lit(x).alias("x0"), text.alias("text"))
    words = F.array(word(0, 10.0, 0.0, F.col("s_name")), word(1, 10.0, 12.0, F.lit("x")), word(2, 11.0, 95.0, k.cast("string")), word(3, 60.0, 95.0, F.lit("below")))
    columns = s.select(k.alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col_no")).withColumn("x0", F.col("col_no") * 100.0)
    return geometry.words_row(s.select(k.alias("page_id"), F.explode(words).alias("w")).select("page_id", "w.*"), columns, 0.0, 30.0)


@query("""SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 3 = 0 THEN 'rebuilt' ELSE 'lines' END AS how, CASE WHEN s_suppkey % 3 = 2 THEN 'side,' || s_name || ',1;side,b,2' WHEN s_suppkey % 3 = 1 THEN s_name || ',1;b,2' ELSE s_name || ',7;k,8;m,9' END AS rows FROM supplier""")
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled tables of pages: sound ones, ones with a column beside them, and degenerate ones made anew from words."""
    s, k = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    sound = F.array(F.array(F.col("s_name"), F.lit("1")), F.array(F.lit("b"), F.lit("2")))
    flat = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.array(F.concat(F.lit("x"), i.cast("string"))))
    tables = s.select(k.alias("page_id"), F.when(k % 3 == 0, flat).otherwise(sound).alias("rows"), F.lit(100.0).alias("left"), F.lit(300.0).alias("right"), F.lit(50.0).alias("top"), F.lit(90.0).alias("bottom"))
    word = lambda i, top, x, text: F.struct(F.lit(i).alias("word_id"), F.lit(x).alias("x0"), F.lit(x + 20).alias("x1"), F.lit(top).alias("top"), F.lit(top + 8).alias("bottom"), text.alias("text"))
    beside = F.array(word(0, 52.0, 60.0, F.lit("side")), word(1, 72.0, 60.0, F.lit("side")))
    inside = F.array(word(0, 50.0, 110.0, F.col("s_name")), word(1, 51.0, 250.0, F.lit("7")), word(2, 70.0, 111.0, F.lit("k")), word(3, 70.0, 251.0, F.lit("8")), word(4, 95.0, 110.0, F.lit("m")), word(5, 95.0, 250.0, F.lit("9")), word(6, 400.0, 110.0, F.lit("far")))
    words = s.select(k.alias("page_id"), F.explode(F.when(k % 3 == 0, inside).when(k % 3 == 2, beside).otherwise(F.slice(inside, 7, 1))).alias("w")).select("page_id", "w.*")
    got = pages.recognise_words(tables, words)
    return got.select("page_id", "how", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS file_id, count(*) FILTER (s_suppkey % 3 = 0) AS degenerate FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_suppkey % 3 = 0) > 0""")
def degenerate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    chunks = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("file_id"), F.when(k % 3 == 1, 2).otherwise(1).alias("n_cols"), F.when(k % 3 == 2, 3).otherwise(4).alias("n_rows"))
    return reports.degenerate(chunks)


@query("""WITH d AS (SELECT doc_id, text, regexp_replace(text, '\\s', '', 'g') AS t FROM documents),
n AS (SELECT doc_id, text, length(t) AS n, length(regexp_replace(t, '[\\p{L}\\p{N}]', '', 'g')) AS odd, length(array_to_string(regexp_extract_all(text, '[A-Za-z]{2,}'), '')) AS latin FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'C' END WHEN length(coalesce(text, '')) / (doc_id % 4 + 1) > 50 AND NOT (n >= 100 AND odd > 0.5 * n AND latin < 0.25 * n) THEN 'B' ELSE 'D' END AS category FROM n""")
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of PDFs by their text layer and of images by their ruled lines."""
    d, k = _read(spark, sf_dir, "documents"), F.col("doc_id")
    suffix, lines = F.when(k % 3 == 2, "PNG").otherwise("pdf"), F.when(k % 2 == 0, 2).otherwise(3)
    return d.select("doc_id", files.category(suffix, F.col("text"), k % 4 + 1, lines).alias("category"))


@query("""WITH p AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END AS c, CASE WHEN s_suppkey % 5 < 2 THEN 1 + s_suppkey % 4 ELSE 1 END AS n FROM supplier)
SELECT coalesce(c, '?') AS category, CASE WHEN c IN ('A', 'B') THEN 'text' ELSE 'vision' END AS route, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS pages,
  arg_min(s_suppkey, (-n, s_suppkey)) AS busiest FROM p GROUP BY 1, 2""")
def route_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and pages by category and route, and the file with most pages of each."""
    k = F.col("s_suppkey")
    held = _read(spark, sf_dir, "supplier").select(k.alias("file_id"), F.when(k % 5 < 4, _pick(["A", "B", "C", "D"], k % 5)).alias("category"), F.when(k % 5 < 2, 1 + k % 4).otherwise(F.lit(None)).cast("int").alias("n_pages"))
    return reports.route_distribution(files.pages_of(held))


# --- stores -----------------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each part: its brand is the file."""
    p = _read(spark, sf_dir, "part")
    heads = F.array(F.lit("型号"), F.col("p_type"), F.lit("a\nb"))
    note = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("零件 "), F.col("p_name"))).otherwise("")
    text = retrieve.chunk_text(F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(""), F.col("p_size"), F.lit(2), F.lit(3), F.lit(None).cast("string"), note, heads, F.lit("<table></table>"))
    return p.select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_brand").alias("file_id"), F.col("p_brand").alias("file_name"), _pick(["text", "vision"], F.col("p_partkey")).alias("source_engine"), "p_partkey", text.alias("chunk_text"))


@query("""SELECT p_partkey, '文件: ' || p_brand || chr(10) || '表名: ' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '-' END || chr(10) || '页码: ' || p_size || chr(10) || '行列: 2x3' || chr(10) || '单位: -' || chr(10) ||
  '业务: ' || CASE WHEN p_partkey % 2 = 0 THEN '零件 ' || p_name ELSE '含列: 型号 / ' || p_type || ' / a' || chr(10) || 'b' END || chr(10) || repeat('表头: 型号 | ' || p_type || ' | a b' || chr(10), 3) || '<table></table>' AS chunk_text FROM part""")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("p_partkey", "chunk_text")


@query("""SELECT p_brand AS file_id, count(*) AS chunks, bool_and(p_partkey % 400 <> 0) AS fresh FROM part GROUP BY 1""")
def fresh_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose chunks are all of the current template; some chunks hold one header line only."""
    old = F.regexp_replace("chunk_text", r"(?s)(表头: [^\n]*\n)+", "表头: x\n")
    return retrieve.fresh_template(_chunks(spark, sf_dir).withColumn("chunk_text", F.when(F.col("p_partkey") % 400 == 0, old).otherwise(F.col("chunk_text"))))


@query("""SELECT 'all' AS scope, NULL AS name, count(*) AS n FROM part UNION ALL SELECT 'file', p_brand, count(*) FROM part GROUP BY 2
UNION ALL SELECT 'engine', CASE WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'vision' END, count(*) FROM part GROUP BY 2""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.store_stats(_chunks(spark, sf_dir))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, (SELECT count(*) FROM part) AS total FROM part ORDER BY 1 LIMIT 100 OFFSET 7""")
def browsed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the collection, cut to the longest page, with the size of the whole."""
    chunks = _chunks(spark, sf_dir)
    return store.browse(chunks, limit=500, offset=7).select("chunk_id").crossJoin(F.broadcast(chunks.agg(F.count("*").alias("total"))))  # one row


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS file_id, count(*) AS tables, CASE WHEN s_nationkey % 5 = 0 THEN 'new' ELSE 'old' END AS prompt_fp, s_nationkey % 5 <> 0 AS stale FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY s_nationkey
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 0, NULL, true FROM supplier GROUP BY s_nationkey HAVING count(*) FILTER (s_suppkey % 7 <> 0) = 0""")
def tables_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised tables written, some files' replaced under new prompts, read again, and the files to recognise anew."""
    s, k = _read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    made = s.select(F.col("s_nationkey").cast("string").alias("file_id"), k.cast("string").alias("table_id"), F.when(k % 7 != 0, "<table></table>").alias("html"))
    path = _folder(spark, "tables")
    store.save_tables(made, path, "old")
    store.save_tables(made.where("CAST(file_id AS INT) % 5 = 0"), path, "new")
    held = store.load_tables(spark, path)
    all_files = made.select("file_id").distinct()
    stale = store.missing(all_files, held, "new").select("file_id", F.lit(True).alias("stale"))
    kept = held.groupBy("file_id").agg(F.count("*").alias("tables"), F.max("prompt_fp").alias("prompt_fp"))
    return all_files.join(kept, "file_id", "left").join(stale, "file_id", "left").select("file_id", F.coalesce("tables", F.lit(0)).cast("long").alias("tables"), "prompt_fp", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("""SELECT p_brand AS file_id, CASE WHEN p_size < 10 THEN 'second' ELSE 'first' END AS version, count(*) AS n FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part) GROUP BY 1, 2""")
def vectors_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks inserted, some replaced by id, and one file's deleted."""
    p = _read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_brand").alias("file_id"), F.lit("first").alias("version"), "p_size")
    path = _folder(spark, "chunks")
    store.upsert(spark, rows, path)
    store.upsert(spark, rows.where("p_size < 10").withColumn("version", F.lit("second")), path)
    first = p.agg(F.min("p_brand")).first()[0]
    store.remove_file(spark, path, first)
    return spark.read.parquet(path).groupBy("file_id", "version").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey % 3 AS part, count(*) AS n, CAST(sum(length(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS size, count(*) FILTER (o_orderkey % 3 = 0) AS open FROM orders GROUP BY 1""")
def answers_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records written in two runs; what the first has is not asked again."""
    asked = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("question_id"), (F.col("o_orderkey") % 3).alias("part"))
    path = _folder(spark, "answers")
    record = lambda rows: rows.select("question_id", F.concat(F.lit(""), F.col("question_id")).alias("answer"), F.lit(0.9).alias("score"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("events"))
    store.save_answers(record(asked.where("part > 0")), path)
    rest = cut(store.unanswered(asked, store.load_answers(spark, path)), "open")
    store.save_answers(record(rest), path)
    done = store.load_answers(spark, path).join(asked, "question_id").join(rest.select("question_id", F.lit(True).alias("_open")), "question_id", "left")
    return done.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("answer")).alias("size"), F.count_if(F.coalesce("_open", F.lit(False))).alias("open"))


@query("""SELECT c_custkey AS id, c_name || ', "' || c_mktsegment || '"' || chr(10) || 'x' AS question, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS hint FROM customer""")
def sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question sheet written as CSV and read back: quotes, commas, line breaks, blanks; rows keep their number."""
    c = _read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"\nx')).alias("question"), F.when(F.col("c_custkey") % 2 == 0, None).otherwise(F.col("c_mktsegment")).alias("hint"))
    path = _folder(spark, "sheet")
    rows.coalesce(1).write.option("header", True).option("escape", '"').csv(path)  # one sheet is one file
    return sheets.read_sheet(spark, path).select(F.col("id").cast("long").alias("id"), "question", "hint")


# --- records ----------------------------------------------------------------------------------

_RECORDS = """a AS (SELECT CAST(o_orderkey AS VARCHAR) AS question_id, o_orderpriority, o_orderkey AS k, CAST(o_orderkey % 50 AS VARCHAR) || '.pdf' AS file_name, o_orderkey % 10 / 10.0 AS score,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '数据未提供' WHEN 2 THEN 'nan' WHEN 3 THEN '[null, ""]' ELSE CAST(o_orderkey AS VARCHAR) END AS answer,
  CASE o_orderkey % 3 WHEN 0 THEN 'rag_miss;no_table' WHEN 1 THEN 'rag_miss' ELSE '' END AS events FROM orders)"""


@query(f"""WITH {_RECORDS} SELECT k % 40 AS part, count(*) AS n, count(*) FILTER (k % 2 = 0) AS answered, count(*) FILTER (k % 2 = 0 AND score < 0.5) AS low, count(*) FILTER (k % 50 < 25) AS known FROM a WHERE contains(question_id, '7') GROUP BY 1""")
def question_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of questions with categories and answers, filtered by a text."""
    a = _answers(spark, sf_dir).withColumn("k", F.col("question_id").cast("long"))
    asked = a.select("question_id", "k", "file_name", F.lit("extract").alias("question_type"), F.lit("名称").alias("question"), F.array().cast("array<string>").alias("repaired"))
    profiles = spark.range(25).select(F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("file_name"), F.lit("B").alias("category"))
    records = a.where("k % 2 = 0").select("question_id", "answer", "score")
    listed = reports.question_list(asked, profiles, records, kind="extract", needle="7").where(F.contains("question_id", F.lit("7")))
    low = reports.question_list(asked, profiles, records, status="low").select("question_id", F.lit(True).alias("_low"))
    answered = F.col("answer").isNotNull()
    return listed.join(low, "question_id", "left").groupBy((F.col("k") % 40).alias("part")).agg(F.count("*").alias("n"), F.count_if(answered).alias("answered"), F.count_if(F.coalesce("_low", F.lit(False))).alias("low"), F.count_if(F.col("category") == "B").alias("known"))


@query(f"""WITH {_RECORDS} SELECT question_id, CASE WHEN k % 3 = 0 THEN 'fixed ' || question_id ELSE answer END AS answer FROM a""")
def backfilled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    fixes = a.where(F.col("question_id").cast("long") % 3 == 0).select("question_id", F.concat(F.lit("fixed "), F.col("question_id")).alias("answer"))
    return reports.backfill(a, fixes).select("question_id", "answer")


@query("""SELECT s_suppkey, s_name AS file_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)""")
def files_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that some question asks about."""
    held = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("file_name"))
    asked = _read(spark, sf_dir, "lineitem").where("l_quantity = 50").join(held, F.col("l_suppkey") == F.col("s_suppkey")).select("file_name")
    return store.needed(held, asked)


@query("""SELECT CAST(user_id AS VARCHAR) AS question_id, CAST(sum(event_id % 11) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS output_tokens, count(*) AS calls FROM events GROUP BY 1""")
def usage_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return reports.usage_of_questions(e.select(F.col("user_id").cast("string").alias("question_id"), (F.col("event_id") % 11).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens")))


@query("""WITH d AS (SELECT event_type || ',' || sum(event_id % 11) || ',' || sum(event_id % 7) || ',' || sum(event_id % 11 + event_id % 7) || ',' || count(*) AS line, event_type AS t FROM events GROUP BY event_type
  UNION ALL SELECT 'TOTAL,' || sum(event_id % 11) || ',' || sum(event_id % 7) || ',' || sum(event_id % 11 + event_id % 7) || ',' || count(*), NULL FROM events)
SELECT chr(65279) || 'phase,input_tokens,output_tokens,total_tokens,calls' || chr(10) || string_agg(line, chr(10) ORDER BY t NULLS LAST) || chr(10) AS csv FROM d""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    usage = e.select(F.col("event_type").alias("phase"), (F.col("event_id") % 11).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"))
    return spark.createDataFrame([(store.cost_report(usage).decode("utf-8"),)], "csv string")


@query(f"""WITH {_RECORDS} SELECT question_id AS id, answer, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, CAST(score AS DOUBLE) AS score, events FROM a""")
def debug_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return store.debug_sheet(a.select("question_id", "answer", A.confidence(F.col("score")).alias("confidence"), "score", F.split("events", ";").alias("events")))


@query(f"""WITH {_RECORDS}, c AS (SELECT *, CASE WHEN k % 7 IN (0, 2) THEN 'invalid' WHEN k % 7 IN (1, 3) THEN 'suspect' ELSE 'valid' END AS class FROM a)
SELECT question_id, CASE WHEN class = 'invalid' AND k % 3 = 0 THEN 'empty,no_table' WHEN class = 'invalid' THEN 'empty' WHEN class = 'suspect' THEN 'suspect' ELSE 'no_table' END AS why FROM c
WHERE class <> 'valid' AND NOT (class = 'suspect' AND k % 3 = 0) OR class = 'valid' AND k % 3 = 0
UNION ALL SELECT question_id, 'suspect,no_table' FROM c WHERE class = 'suspect' AND k % 3 = 0""")
def trace_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers worth a look, and why."""
    return reports.drilldown(_answers(spark, sf_dir), "no_table").select("question_id", F.array_join("why", ",").alias("why"))


@query(f"""WITH {_RECORDS} SELECT k % 20 AS part, count(*) AS n, count(*) FILTER (k % 4 <> 0) AS answered, count(*) FILTER (k % 4 = 1) AS debugged FROM a GROUP BY 1""")
def joined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their answers and debug rows, each where there is one."""
    a = _answers(spark, sf_dir).withColumn("k", F.col("question_id").cast("long"))
    made = reports.joined(a.select("question_id", "k"), a.where("k % 4 <> 0").select(F.col("question_id").alias("id"), "answer"), a.where("k % 4 = 1").select(F.col("question_id").alias("id"), "score", "events"))
    return made.groupBy((F.col("k") % 20).alias("part")).agg(F.count("*").alias("n"), F.count("answer").alias("answered"), F.count("score").alias("debugged"))


@query("""SELECT p_partkey % 10 AS part, count(*) AS n, count(*) FILTER (p_partkey % 5 <> 4) AS replied, count(*) FILTER (p_partkey % 5 = 4) AS refused, CAST(sum(CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE length(p_name) END) AS BIGINT) AS input_tokens FROM part GROUP BY 1""")
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a model that answers most prompts and refuses some, with their tokens."""

    def chat(prompt: str):
        if prompt.startswith("no "):
            raise ValueError("refused")
        return seams.Reply(prompt.upper(), len(prompt), 1)

    k = F.col("p_partkey")
    asked = _read(spark, sf_dir, "part").select(k.cast("string").alias("question_id"), F.lit("op").alias("phase"), F.when(k % 5 == 4, F.concat(F.lit("no "), F.col("p_name"))).otherwise(F.col("p_name")).alias("prompt"))
    got = seams.call_model(asked, chat, at_once=8)
    return got.groupBy((F.col("question_id").cast("long") % 10).alias("part")).agg(F.count("*").alias("n"), F.count("reply").alias("replied"), F.count_if(F.col("error") == "refused").alias("refused"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) || ':p1:' || 0 AS table_id, CASE WHEN s_suppkey % 3 = 0 THEN 'text' ELSE 'vision' END AS source_engine, 'table ' || s_suppkey AS table_name,
  '业务: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'line ' || s_suppkey ELSE '含列: a / b' END AS business FROM supplier WHERE s_suppkey % 4 <> 3""")
def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages recognised by the text layer or the vision model, and their chunks: pages without a table give none."""

    def table(path: str) -> str:
        return f"TABLE_NAME: table {path}\n<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>"

    def read(prompt: str, path: str, page: int):
        return table(path) if int(path) % 3 == 0 and int(path) % 4 != 3 else "no table"

    def see(prompt: str, path: str, page: int):
        if prompt == "table_recognition" and int(path) % 5 == 0:
            raise TimeoutError("timed out")
        return table(path) if int(path) % 4 != 3 else None

    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_id"), F.col("s_suppkey").cast("string").alias("path"), F.lit(1).alias("page"), _pick(["B", "C", "D"], F.col("s_suppkey")).alias("category"), F.col("s_name").alias("file_name"), F.lit(None).cast("string").alias("dedup_of"))
    tables = cut(ingest.recognise(s, read, see), "tables")
    notes = tables.where(F.col("file_id").cast("int") % 2 == 0).select("table_id", F.concat(F.lit("line "), F.col("file_id")).alias("annotation"))
    got = ingest.chunks(tables, s.select("file_id", "file_name", "dedup_of"), notes)
    return got.select("table_id", "source_engine", "table_name", F.regexp_extract("chunk_text", r"(?m)^业务: .*$", 0).alias("business"))


@query("""WITH x AS (SELECT CAST(k AS INTEGER) AS k FROM range(6) r(k)) SELECT CAST(k AS VARCHAR) AS question_id, CASE k WHEN 0 THEN 'p2' WHEN 1 THEN 'p2' WHEN 2 THEN 'p1' WHEN 3 THEN 'p1' WHEN 4 THEN 'p3' ELSE 'p1' END AS table_id,
CAST(CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.2 WHEN 3 THEN 0 WHEN 4 THEN 0.4 ELSE 0.3 END AS DOUBLE) AS score, CASE WHEN k IN (2, 3) THEN 'table_select_low' ELSE '' END AS events FROM x""")
def table_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of a table: by its name in the question, by a hint, by page, by nothing, by retrieval, by shared words."""
    asked = spark.createDataFrame(
        [("0", "the sales of spring", "", None), ("1", "what", "spring", None), ("2", "what", "", 1), ("3", "what", "", 9), ("4", "what", "", None), ("5", "alpha beta", "", None)],
        "question_id string, question string, table_hint string, page_lo int",
    ).withColumn("page_hi", F.col("page_lo"))
    tables = spark.createDataFrame(
        [("p1", "winter", 1, 3, True, ["alpha", "beta"]), ("p2", "spring", 2, 3, True, ["gamma"]), ("p3", "autumn", 3, 3, True, ["delta"]), ("p4", "the sales", 1, 3, False, ["alpha"]), ("p5", "what", 1, 1, False, ["what"])],
        "table_id string, table_name string, page int, n_rows int, has_data boolean, headers array<string>",
    ).withColumn("masked", F.lit(False)).withColumn("second_row", F.array(F.lit("1")))
    hits = spark.createDataFrame([("4", 3, "autumn", 0.9, 0.05), ("4", 1, None, 0.4, None)], "query_id string, page int, table_name string, similarity double, rerank_bonus double")
    met = asked.join(tables, F.lit(True))  # six questions by five tables
    got = retrieve.select_table(met, hits)
    return got.select("question_id", "table_id", F.round("score", 6).alias("score"), F.array_join("events", ";").alias("events"))


@query("""WITH k AS (SELECT CAST(c_nationkey AS VARCHAR) AS n, count(*) AS c, min(c_custkey) AS m FROM customer GROUP BY 1)
SELECT n || '-vision' AS question_id, CAST(m AS VARCHAR) AS answer, 'vision_extract' AS events FROM k
UNION ALL SELECT n || '-code', CAST(c AS VARCHAR), 'code' FROM k
UNION ALL SELECT n || '-range', '{"row_count": ' || (c + 1) || ', "col_count": 2, "cells": [{"row": 0, "col": 0, "rowspan": 1, "colspan": 1, "text": "客户"}, {"row": 0, "col": 1, "rowspan": 1, "colspan": 1, "text": "余额"}]}', '' FROM k
UNION ALL SELECT n || '-lost', '', 'no_table' FROM k""")
def answer_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job where first replies fail: a look at the page, a program after a bad operator, a range that a model names, a file without tables."""
    c = _read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").cast("string").alias("table_id"), F.col("c_custkey").alias("ord"), F.array(F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string")).alias("cells"))
    tables = cut(_html(rows, ["客户", "余额"]), "customers").select("table_id", F.concat("table_id", F.lit(".pdf")).alias("file_name"), F.concat(F.lit("customers "), F.col("table_id")).alias("table_name"), F.lit(1).alias("page"), "html")
    kinds = [("vision", "extract", "竖排的第一个客户", "string"), ("code", "thinking", "客户数", "number"), ("range", "structure", "恢复表头以外不要的结构", "json"), ("lost", "extract", "名称", "string")]
    kinds[2] = ("range", "structure", "恢复最上面的结构", "json")
    names = ["k", "question_type", "question", "answer_format"]
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, kind))) for kind in kinds))
    asked = tables.select("table_id", "file_name", F.explode(each).alias("q")).select("table_id", "file_name", "q.*")
    asked = asked.withColumn("file_name", F.when(F.col("k") == "lost", "none.pdf").otherwise(F.col("file_name"))).withColumn("question_id", F.concat_ws("-", "table_id", "k"))
    asked = asked.withColumn("table_hint", F.lit("")).withColumn("format_note", F.lit(None).cast("string"))
    least = c.groupBy(F.col("c_nationkey").cast("string").alias("table_id")).agg(F.min("c_custkey").cast("string").alias("m"))
    program = json.dumps([{"agg": {"values": {"n": ["count", "客户"]}}}], ensure_ascii=False)
    said = asked.join(least, "table_id").select("question_id", F.explode(F.array(
        F.struct(F.when(F.col("k") == "vision", "extract").alias("phase"), F.lit("nothing").alias("reply")),
        F.struct(F.when(F.col("k") == "vision", "vision").alias("phase"), F.concat(F.lit('{"value": "'), F.col("m"), F.lit('"}')).alias("reply")),
        F.struct(F.when(F.col("k") == "code", "op").alias("phase"), F.lit('{"op": "none"}').alias("reply")),
        F.struct(F.when(F.col("k") == "code", "code").alias("phase"), F.lit(program).alias("reply")),
        F.struct(F.when(F.col("k") == "range", "range").alias("phase"), F.lit('{"row_range": [0, 0]}').alias("reply")),
    )).alias("r")).select("question_id", "r.*").where("phase IS NOT NULL")
    got = plan.answer(asked, tables, said)
    seen = F.array_join(F.filter("events", lambda e: e.isin("vision_extract", "code", "no_table")), ";")
    return got.select("question_id", "answer", seen.alias("events"))


@query("""SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || ': ' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || ' [1][2]' AS prompt FROM part""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for all rows from one template with a condition and a loop."""
    template = "Part {{ name }} of {{ brand }}: {% if large %}large{% else %}small{% endif %} {% for x in list %}[{{ x }}]{% endfor %}"
    values = {"name": F.col("p_name"), "brand": F.col("p_brand"), "large": F.col("p_size") > 25, "list": F.array(F.lit("1"), F.lit("2"))}
    return _read(spark, sf_dir, "part").select("p_partkey", prompts.rendered(template, values).alias("prompt"))


@query(f"""WITH {_RECORDS}, w AS (SELECT question_id, row_number() OVER (ORDER BY question_id) AS r FROM a) SELECT count(*) AS n, count(DISTINCT question_id) AS ids, true AS same FROM (SELECT * FROM a LIMIT 40)""")
def sampled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of forty answers: the same ones however the table is partitioned."""
    a = _answers(spark, sf_dir)
    one = reports.sample(a, 40, seed=3).select("question_id")
    two = reports.sample(a.repartition(7), 40, seed=3).select("question_id", F.lit(1).alias("_again"))
    both = one.join(two, "question_id", "left")
    return both.agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("ids"), F.bool_and(F.col("_again").isNotNull()).alias("same"))


@query("""WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.vec_id % 2 = 0 AS has_keyword, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM x)
SELECT query_id, chunk_id, has_keyword, rank, CASE WHEN rank <= 3 THEN rank END AS place FROM r WHERE rank <= 6""")
def retrieval_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a query's chunks stand by cosine and after the rerank, and which hold a keyword."""
    e = _read(spark, sf_dir, "embeddings")
    text = F.concat(F.lit("表名: -\n表头: none\n"), F.when(F.col("vec_id") % 2 == 0, "key").otherwise(""))
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("file_id"), text.alias("chunk_text"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("？").alias("question"), F.col("embedding").alias("vector"), F.col("label").alias("file_id"))
    got = quality.diagnose_retrieval(asked, chunks, "key")
    return got.select("query_id", "chunk_id", "has_keyword", "rank", F.when(F.col("place") <= 3, F.col("place")).alias("place"))


# --- files, maintenance and small rules -------------------------------------------------------


@query("""SELECT lpad(CAST(r_regionkey AS VARCHAR), 3, '0') || '.' || CASE WHEN r_regionkey % 2 = 0 THEN 'pdf' ELSE 'PNG' END AS file_name, CAST(strlen(r_name) AS BIGINT) AS length, substr(sha1(r_name), 1, 12) AS file_id FROM region""")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of documents with their content hashes; files of other kinds are left out."""
    path = _folder(spark, "documents")
    fs, _ = store._files(spark, path)
    for key, name in _read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five files
        for suffix in ("pdf" if key % 2 == 0 else "PNG", "txt"):
            with_name = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key:03d}.{suffix}")
            out = fs.create(with_name, True)
            out.write(bytearray(name.encode()))
            out.close()
    return files.scan(spark, path).select("file_name", "length", "file_id")


@query("""SELECT o_orderkey AS row_no FROM orders WHERE o_orderkey % 10 < 3 ORDER BY o_orderkey LIMIT 25""")
def limited_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of listed ids, then the first by row: both limits are the feature."""
    asked = _read(spark, sf_dir, "orders").where("o_orderkey % 10 < 3").select(F.col("o_orderkey").alias("row_no"), F.col("o_orderkey").cast("string").alias("question_id"))
    first = [r[0] for r in questions.only(asked, limit=25).select("question_id").collect()]  # the length of the limit
    return questions.only(asked, ids=first, limit=40).select("row_no")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS n FROM orders""")
def counting_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that answer how many with their length; other lists stay lists."""
    k = F.col("o_orderkey")
    item = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("is_int"), F.lit("x").alias("text")).cast(A.VALUE)
    items = F.slice(F.array_repeat(item, 4), 1, (k % 4).cast("int"))
    asked = F.when(k % 3 == 1, "列出所有名称").otherwise("一共有多少个项目")
    form = F.when(k % 3 == 2, "json_array").otherwise("number")
    return _read(spark, sf_dir, "orders").select("o_orderkey", A.count_if_counting(items, form, asked).alias("n"))


@query(f"""WITH {_RECORDS}, c AS (SELECT *, CASE WHEN k % 7 IN (0, 2) THEN 'invalid' WHEN k % 7 IN (1, 3) THEN 'suspect' ELSE 'valid' END AS class FROM a)
SELECT count(*) AS n, count(*) FILTER (class = 'valid') AS valid, count(*) FILTER (class = 'suspect') AS suspect, count(*) FILTER (class = 'invalid') AS invalid,
  round(count(*) FILTER (class = 'valid') / count(*), 4) AS rate, round(CAST(avg(score) FILTER (class = 'valid') AS DOUBLE), 4) AS avg_score, count(DISTINCT file_name) AS files FROM c""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(_answers(spark, sf_dir).withColumn("class", reports.validity(F.col("answer"))))


@query(f"""WITH {_RECORDS}, c AS (SELECT *, CASE WHEN k % 7 IN (0, 2) THEN 'invalid' WHEN k % 7 IN (1, 3) THEN 'suspect' ELSE 'valid' END AS class FROM a)
SELECT 'file' AS scope, file_name AS name, count(*) AS n FROM c WHERE class = 'invalid' GROUP BY 2
UNION ALL SELECT 'confidence', CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END, count(*) FROM c GROUP BY 2""")
def quality_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid answers by file, and all answers by confidence."""
    rows = _answers(spark, sf_dir).withColumn("class", reports.validity(F.col("answer"))).withColumn("confidence", A.confidence(F.col("score")))
    return reports.distributions(rows)


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS file_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'other' END AS prompt_fp, count(*) AS n FROM supplier GROUP BY 1, 2""")
def rewritten_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tables of one set of prompts marked as those of another; the rest stays."""
    s = _read(spark, sf_dir, "supplier")
    path = _folder(spark, "fingerprints")
    made = s.select(F.concat(F.col("s_nationkey").cast("string")).alias("file_id"), F.col("s_suppkey").cast("string").alias("table_id"), F.lit("<table></table>").alias("html"), F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise("other").alias("prompt_fp"))
    made.write.partitionBy("file_id").parquet(path)
    store.rewrite_fingerprint(spark, path, "old", "new")
    return store.load_tables(spark, path).groupBy("file_id", "prompt_fp").agg(F.count("*").alias("n"))


@query("""SELECT p_brand AS file_id, CAST(sum(length(p_name)) AS DOUBLE) AS total, count(*) AS n FROM part GROUP BY 1""")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from a model that takes twenty texts at once."""

    def encode(texts: list[str]) -> list[list[float]]:
        if len(texts) > 20:
            raise ValueError("too many texts")
        return [[float(len(t)), 1.0] for t in texts]

    rows = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("file_id"), F.col("p_name").alias("chunk_text"))
    made = seams.embed(rows, encode, at_once=8)
    return made.groupBy("file_id").agg(F.sum(F.get("vector", F.lit(0)).cast("double")).alias("total"), F.sum(F.get("vector", F.lit(1))).cast("long").alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS table_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'about ' || p_brand END AS annotation FROM part""")
def annotated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line about each table from a model; a call that fails gives an empty line."""

    def chat(prompt: str) -> str:
        if "refuse" in prompt:
            raise ValueError("refused")
        return " about " + prompt.split(":")[1] + "\n"

    tables = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("table_id"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "refuse:").otherwise("say:"), F.col("p_brand")).alias("html"))
    return ingest.annotate(tables, "{{ html }}", chat)


@query("""SELECT 'op' AS phase, CAST(sum(length(p_name)) FILTER (p_partkey % 5 <> 4) AS BIGINT) AS input_tokens, count(*) FILTER (p_partkey % 5 <> 4) AS output_tokens FROM part""")
def recorded_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage of calls as the cost report reads it; refused calls count nothing."""

    def chat(prompt: str):
        if prompt.startswith("no "):
            raise ValueError("refused")
        return seams.Reply("ok", len(prompt), 1)

    k = F.col("p_partkey")
    asked = _read(spark, sf_dir, "part").select(k.cast("string").alias("question_id"), F.lit("op").alias("phase"), F.when(k % 5 == 4, F.concat(F.lit("no "), F.col("p_name"))).otherwise(F.col("p_name")).alias("prompt"))
    return seams.usage(seams.call_model(asked, chat)).groupBy("phase").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
