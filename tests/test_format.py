import pytest
from pyspark.sql import functions as F

from tessella.functions import similarity
from tessella.functions import text as X
from tessella.operators import format as A
from tessella.operators import questions, reports

LISTS = f"array<{A.VALUE}>"


def value(v):
    if v is None:
        return None
    return ("num", float(v), float(v).is_integer(), None) if isinstance(v, (int, float)) else ("text", None, None, v)


def answer(spark, v, fmt, places=None, question=None):
    row = (None, [value(x) for x in v]) if isinstance(v, list) else (value(v), None)
    frame = spark.createDataFrame([(*row, fmt, places, question)], f"v {A.VALUE}, items {LISTS}, f string, p int, q string")
    return frame.select(A.format_answer(F.col("v"), F.col("items"), F.col("f"), F.col("p"), F.col("q")).alias("a")).first()["a"]


@pytest.mark.parametrize(
    "v, places, want",
    [
        ("125,000", None, "125000"), ("1,884,661,393.95", None, "1884661393.95"), (0.125, 2, "0.12"), (3, 1, "3.0"), (100.0, None, "100"), (12.30, None, "12.3"),
        (1e-10, None, "0.0000000001"), (None, None, ""), (float("nan"), None, ""), ("[MASK]", None, ""), ("未找到", None, ""), ("--", None, "0"), ("9,3", None, "9.3"),
        ("(7,756)", None, "-7756"), ("约￥116.03㎡", None, "116.03"), ("5045 (33.1)", None, "5045"), ("12%", None, "12"), (2.675, 2, "2.67"),
    ],
)
def test_number(spark, v, places, want):
    assert answer(spark, v, "number", places) == want


@pytest.mark.parametrize(
    "v, fmt, question, want",
    [
        (["9,3", "10"], "json_array", None, "[9.3, 10]"), (["x"], "string", None, "x"), ([69.49], "string", None, "69.49"), (["a", "b"], "string", None, '["a", "b"]'), ('["x"]', "string", None, "x"),
        ([1, "销售额", None], "json_array", None, '[1, "销售额", ""]'), (["a", float("nan")], "json_array", None, '["a", ""]'), (["125,000", "x"], "json_array", None, '[125000, "x"]'),
        (["01", "058"], "json_array", None, '["01", "058"]'), (["", 46.0, "A"], "json_array", "以下字段依次是", '["", 46, "A"]'), (["A", "", "B", None], "json_array", "列出所有", '["A", "B"]'),
        ("１２３４５", "string", None, "12345"), (" 01 号 ", "string", None, "01 号"), ("a  \t b", "string", None, "a b"), (5, "string", None, "5"), ('{"a": 1}', "json", None, '{"a": 1}'),
    ],
)
def test_other_formats(spark, v, fmt, question, want):
    assert answer(spark, v, fmt, None, question) == want


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s, q, want", [("79、吴沙、无、3", "依次是", ["79", "吴沙", "无", "3"]), ("188,661,393.95", "依次是", None), ("抱歉。a,b", "依次是", None), ("a,b", "各是多少", None), ("a", "依次是", None)])
def test_compound(spark, s, q, want):
    assert one(spark, A.split_compound(F.col("s"), F.col("q")), s=s, q=q) == want


@pytest.mark.parametrize(
    "q, want",
    [
        ("恢复第3行的表格结构", (None, (2, 2), None)), ("恢复第2列的结构", (None, None, (1, 1))), ("恢复前3行", (None, (0, 2), None)), ("恢复一下前1行和前1列的表格结构", (None, (0, 0), (0, 0))),
        ("恢复表头行结构", (None, (0, 1), None)), ("恢复第2页的表格", ((2, 2), None, None)), ("第1页到3页", ((1, 3), None, None)), ("前二十三行", (None, (0, 22), None)), ("第十列", (None, None, (9, 9))),
        ("第3行到第5行", (None, (2, 4), None)), ("整表", (None, None, None)), ("", (None, None, None)),
    ],
)
def test_ranges(spark, q, want):
    r = one(spark, questions.parse_range(F.col("q")), q=q)
    got = tuple((r[f"{x}_lo"], r[f"{x}_hi"]) if r[f"{x}_lo"] is not None else None for x in ("page", "row", "col"))
    assert got == want and r["how"] == ("regex" if any(want) else "full")


@pytest.mark.parametrize("said, want", [("string", "string"), ("json", "json"), ("百分比，保留一位小数", "number"), ("JSON数组", "json_array"), ("表格结构 JSON", "json"), ("填写产品名称", "string")])
def test_format_names(spark, said, want):
    assert one(spark, questions.answer_format(F.col("s")), s=said) == want


def test_text_functions(spark):
    assert one(spark, X.precision(F.col("q"), F.lit("")), q="保留两位小数") == 2
    assert one(spark, X.precision(F.col("q"), F.lit("")), q="保留2位小数") == 2
    assert one(spark, X.halfwidth(F.col("s")), s="（元）１２") == "(元)12"
    assert one(spark, X.normalised(F.col("s")), s=" １,2 3％") == "123"
    assert one(spark, X.tokens(F.col("s")), s="营收ab1、增长") == ["ab1", "营收", "收增", "增长"]
    assert one(spark, X.query_tokens(F.col("s")), s="期末余额，多少") == ["期末余额"]
    assert one(spark, X.nouns_missing(F.col("q"), F.col("h")), q="“甲”和“应收账款”", h="<td>无</td>") is True
    assert [one(spark, X.boundary_level(F.col("s")), s=s) for s in ("一、收入", "（二）成本", "负债：", "其中：", "x")] == [3, 2, 1, 0, 0]
    assert one(spark, X.garbled(F.col("s")), s='!"$#a') is True and one(spark, X.garbled(F.col("s")), s="好的12") is False


def test_confidence(spark):
    frame = spark.createDataFrame([(["no_table", "rag_miss"],), ([],), (["no_table"] * 3,), (["odd"],)], "e array<string>")
    scores = [r["s"] for r in frame.select(A.confidence_score(F.col("e")).alias("s")).collect()]
    assert scores == [0.5, 1.0, 0.2, 0.9]


def test_validity(spark):
    said = ["", None, " NaN", "数据未提供", "[null, \"\"]", '{"a": null}', "[1]", "3"]
    rows = spark.createDataFrame([(s,) for s in said], "a string").select(reports.validity(F.col("a")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["invalid", "invalid", "invalid", "suspect", "suspect", "suspect", "valid", "valid"]


def test_edit_ratio():
    assert similarity.indel("abcd", "abed") == 75.0 and similarity.indel("", "") == 100.0
    assert similarity.best_window("财务报表", "2023财务报表附注") == 100.0
