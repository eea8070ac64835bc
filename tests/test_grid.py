import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import text as X
from tessella.operators import grid
from pyspark.sql import functions as F

SIMPLE = "<table><tr><td>城市</td><td>人口</td></tr><tr><td>甲</td><td>12</td></tr><tr><td>乙</td><td>7</td></tr></table>"
MERGED = '<table><tr><td>x</td><td rowspan="3">y</td></tr><tr><td>z</td></tr><tr><td>w</td></tr><tr><td colspan=2>v</td></tr></table>'
HEADED = (
    '<table><tr><td colspan="2">产量</td><td rowspan="2">单位</td></tr><tr><td>东区</td><td>西区</td></tr>'
    "<tr><td>31</td><td>4</td><td>吨</td></tr></table>"
)


def html(text):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c.strip()}</td>" for c in line.split("|")) + "</tr>" for line in text.split("\n")) + "</table>"


def anchors(cells):
    return {(c[0], c[2]) for c in cells if c[6]}


def structure(spark, text, **bounds):
    cells = grid.parse_cells(spark.createDataFrame([("t", text)], "table_id string, html string"))
    ends = [bounds.get(k) for k in ("row_lo", "row_hi", "col_lo", "col_hi")]
    ranges = spark.createDataFrame([("t", *ends)], "table_id string, row_lo int, row_hi int, col_lo int, col_hi int")
    return json.loads(grid.structure_json(cells, ranges).first()["json"])


def test_simple_grid_is_all_anchors():
    cells = grid.place(SIMPLE)
    assert len(cells) == 6 and all(c[6] for c in cells)


def test_merged_cells_are_copied():
    cells = {(c[0], c[2]): c for c in grid.place(MERGED)}
    assert len(cells) == 8 and len(anchors(cells.values())) == 5
    assert {cells[r, 1][3] for r in range(3)} == {"y"} and [cells[r, 1][6] for r in range(3)] == [True, False, False]
    assert cells[3, 1][3] == "v" and not cells[3, 1][6]


def test_partial_structure_is_rows_or_columns(spark):
    s = structure(spark, HEADED, row_lo=0, row_hi=0, col_lo=0, col_hi=0)
    assert (s["row_count"], s["col_count"]) == (3, 3)
    assert [(c["row"], c["col"], c["rowspan"], c["colspan"]) for c in s["cells"]] == [(0, 0, 1, 2), (0, 2, 2, 1), (1, 0, 1, 1), (2, 0, 1, 1)]


def test_one_row_keeps_whole_spans(spark):
    s = structure(spark, MERGED, row_lo=3, row_hi=3)
    assert [(c["row"], c["col"], c["colspan"]) for c in s["cells"]] == [(3, 0, 2)] and s["row_count"] == 4
    s = structure(spark, HEADED, row_lo=1, row_hi=1)
    assert {(c["row"], c["col"]) for c in s["cells"]} == {(1, 0), (1, 1)}


def test_odd_markup():
    assert grid.place(None) == [] and grid.place("no table") == []
    assert [c[3] for c in grid.place("<table><tr><td>a<td>b<br>c &lt;d<tr><tr><th>e")] == ["a", "b\nc <d", "e"]
    rows = grid.place("<table><tr><td>a</td></tr><tr></tr><tr><td>b</td></tr></table>")
    assert [(c[0], c[1]) for c in rows] == [(0, 0), (2, 1)]
    assert grid.place('<table><tr><td rowspan="x" colspan="0">a</td></tr></table>')[0][4:6] == (1, 1)
    hole = grid.place('<table><tr><td rowspan="2">a</td><td>b</td><td rowspan="2">c</td></tr><tr></tr></table>')
    assert (1, 1) in anchors(hole)


def test_vast_cells_end_with_the_table():
    cells = grid.place('<table><tr><td rowspan="65000" colspan="900">a</td></tr><tr><td>b</td></tr></table>')
    assert len(cells) == 1801 and cells[-1][:4] == (1, 1, 900, "b") and cells[0][4:6] == (65000, 900)
    assert len(grid.place('<table><tr><td rowspan="3">a</td></tr></table>')) == 3


cell_text = st.text("ab1 ", min_size=1, max_size=3).map(str.strip).filter(bool)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(cell_text, st.integers(1, 2), st.integers(1, 2)), min_size=1, max_size=3), min_size=1, max_size=3))
def test_same_places_whatever_the_markup(rows):
    said = "<table>" + "".join("<tr>" + "".join(f'<td rowspan="{r}" colspan="{c}">{t}</td>' for t, r, c in row) + "</tr>" for row in rows) + "</table>"
    bare = said.replace("</td>", "").replace("</tr>", "")
    assert grid.place(said) == grid.place(bare)
    places = [(c[0], c[2]) for c in grid.place(said)]
    assert len(places) == len(set(places)) and places == sorted(places)


def test_round_trip(spark):
    t = spark.createDataFrame([("m", MERGED), ("h", HEADED), ("s", SIMPLE)], "table_id string, html string")
    cells = grid.parse_cells(t)
    again = grid.parse_cells(grid.grid_html(cells))
    assert sorted(cells.collect()) == sorted(again.collect())


def typed(spark, text):
    cells = grid.parse_cells(spark.createDataFrame([("t", text)], "table_id string, html string"))
    tcols, tcells = grid.typed(cells)
    names = [r["col_name"] for r in tcols.orderBy("c").collect()]
    return names, [(r["r"], r["c"], r["kind"], r["num"] if r["kind"] == "num" else r["text"]) for r in tcells.orderBy("r", "c").collect()]


def test_typed_table(spark):
    names, cells = typed(spark, html("项目|金额\n收入|1,000\n成本|(200)\n其他|—\n空|"))
    assert names == ["项目", "金额"]
    assert [c[2:] for c in cells if c[1] == 1] == [("num", 1000.0), ("num", -200.0), ("text", "—"), ("null", None)]


def test_headers(spark):
    two = '<table><tr><td colspan="2">收入</td><td colspan="2">成本</td></tr><tr><td>本期</td><td>上期</td><td>本期</td><td>上期</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>'
    assert typed(spark, two)[0] == ["收入:本期", "收入:上期", "成本:本期", "成本:上期"]
    assert typed(spark, html("项目|本期|本期\na|1|2"))[0] == ["项目", "本期", "本期.1"]
    names, cells = typed(spark, html("国别|名称\n美国|x\n美国|y\n中国|z"))
    assert names == ["国别", "名称"] and len(cells) == 6  # all text, no merged cell: one header row
    names, cells = typed(spark, html("a||c\n1|2\n3|4|5|6"))
    assert names == ["a", "col1", "c"] and len(cells) == 6


def test_extracted_tables(spark):
    raw = [("a", "hi ```html TABLE_NAME: one\n<table><tr></table> TABLE_NAME: -\n<TABLE>b</table>```"), ("b", None), ("c", "x<table>n</table>")]
    rows = grid.extract_tables(spark.createDataFrame(raw, "doc_id string, raw string")).orderBy("doc_id", "table_no").collect()
    assert [(r["doc_id"], r["table_name"]) for r in rows] == [("a", "one"), ("a", None), ("c", None)]


@pytest.mark.parametrize(
    "said, num",
    [("1,234.56", 1234.56), ("(1,234)", -1234), ("１２３", 123), ("12.30%", 12.3), ("9,3", 9.3), ("10,25", 10.25), ("1,234", 1234), ("—", None), ("", None), ("12a", None), ("9,3%", 93.0), ("1d", None), ("(-5)", 5.0)],
)
def test_numbers(spark, said, num):
    got = spark.createDataFrame([(said,)], "s string").select(X.number(F.col("s")).alias("n")).first()["n"]
    assert (got and got["num"]) == num


def test_facts(spark):
    t = [("a", html("单位：万元|x\na|")), ("b", html("a|b\nc|[MASK]"))]
    rows = {r["table_id"]: r for r in grid.table_facts(grid.parse_cells(spark.createDataFrame(t, "table_id string, html string"))).collect()}
    assert (rows["a"]["unit_note"], rows["a"]["has_data"], rows["b"]["masked"], rows["b"]["headers"]) == ("万元", False, True, ["a", "b"])
