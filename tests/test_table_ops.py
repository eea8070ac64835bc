import json

import pytest

from tessella.operators import grid, table_ops
from tessella.scratch import cut

from test_grid import html

STATEMENT = html(
    "项目|附注|本期金额|上期金额\n一、营业总收入||1,000.00|900.00\n减：营业成本|40|600.00|550.00\n税金及附加|40|10.00|9.00\n财务费用|41|(20.00)|5.00\n"
    "其中：利息费用|41|30.00|12.00\n利息收入|41|50.00|7.00\n加：其他收益|42|3.00|—\n二、营业利润||413.00|341.00\n加：营业外收入|43|1.00|2.00\n减：营业外支出|44|0.00|1.00"
)
DEBTS = html("科目|附注|年末|年初\n长期债务：|||\n银行贷款||70|60\n公司债|||\n其中：甲类债|||\n乙类债|||\n场地租约||5|4\n长期债务合计||75|64")
GATES = html("站点|晨|晚\n东门|4|9\n西门|–|2\n南门|7|6")
YEARS = html("line|P.0|P.1|P.2\nYear|1998|2001|2004\nOutput|31|12|7")
PLANS = html("plan|basic|full\nmail|✅|✅\ndisk|❌|✅\nhelp|❌|✅")
TABLES = {"S": STATEMENT, "D": DEBTS, "G": GATES, "Y": YEARS, "P": PLANS}


def ref(row, col):
    return {"row": row, "col": col}


CASES = [
    ("S", {"op": "subitems", "item": "财务费用"}, ["利息费用", "利息收入"]),
    ("S", {"op": "subitems", "item": "一、营业总收入"}, ["减：营业成本", "税金及附加", "财务费用", "加：其他收益"]),
    ("S", {"op": "subitems", "item": "二、营业利润"}, ["加：营业外收入", "减：营业外支出"]),
    ("D", {"op": "subitems", "item": "公司债"}, ["甲类债", "乙类债"]),
    ("D", {"op": "subitems", "item": "长期债务："}, ["银行贷款", "公司债", "场地租约"]),
    ("S", {"op": "cell", **ref("营业", "本期金额")}, 0.0),
    ("S", {"op": "cell", **ref("加：其他收益", "上期金额")}, "—"),
    ("S", {"op": "cell", **ref("二、营业利润", "附注")}, 413.0),
    ("S", {"op": "cell", **ref("没有", "附注")}, None),
    ("S", {"op": "cells", "refs": [ref("利息收入", "上期"), ref("营业成本", "本期")]}, [7.0, 600.0]),
    ("S", {"op": "cells", "refs": []}, None),
    ("S", {"op": "diff", "a": ref("一、营业总收入", "本期金额"), "b": ref("减：营业成本", "本期金额")}, 400.0),
    ("S", {"op": "diff", "a": ref("加：其他收益", "上期金额"), "b": ref("减：营业成本", "本期金额")}, None),
    ("S", {"op": "sum", "col": "本期金额", "rows": ["税金及附加", "加：其他收益"]}, 13.0),
    ("S", {"op": "sum", "col": "本期金额", "rows": ["税金及附加", "没有"]}, None),
    ("S", {"op": "sum", "refs": [ref("利息收入", "上期"), ref("营业成本", "本期")]}, 607.0),
    ("S", {"op": "avg", "col": "本期金额", "rows": ["税金及附加", "加：其他收益"]}, 6.5),
    ("S", {"op": "ratio_sum", "num_col": "上期金额", "den_col": "本期金额", "rows": ["减：营业成本", "税金及附加"]}, 91.64),
    ("S", {"op": "ratio_sum", "num_col": "上期金额", "den_col": "本期金额", "rows": ["减：营业外支出"]}, None),
    ("S", {"op": "count", "contains": "其中："}, 1.0),
    ("S", {"op": "count", "contains": "没有"}, None),
    ("S", {"op": "count"}, 10.0),
    ("P", {"op": "contains", "text": "❌"}, "是"),
    ("P", {"op": "contains", "text": "☆"}, "否"),
    ("S", {"op": "argmax", "col": "本期金额"}, "一、营业总收入"),
    ("S", {"op": "argmin", "col": "本期金额"}, "财务费用"),
    ("D", {"op": "argmax", "col": "年末"}, "银行贷款"),
    ("G", {"op": "argmax", "col": "晨"}, "南门"),
    ("G", {"op": "argmin", "col": "晚"}, "西门"),
    ("G", {"op": "rowmax", "row": "东门"}, "晚"),
    ("G", {"op": "rowmin", "row": "南门"}, "晚"),
    ("S", {"op": "rowmax", "row": "财务费用"}, "附注"),
    ("Y", {"op": "rowmax", "row": "Output"}, "1998"),
    ("P", {"op": "colcount", "match": "✅"}, "full"),
    ("P", {"op": "colcount", "match": "☆"}, None),
    ("S", {"op": "nonzero", "col": "本期金额", "after_row": "二、营业利润"}, ["加：营业外收入"]),
    ("S", {"op": "const", "value": "是"}, "是"),
    ("S", {"op": "const", "value": ""}, None),
    ("S", {"op": "seq", "ops": [{"op": "const", "value": 1}, {"op": "cell", **ref("税金及附加", "本期金额")}]}, [1.0, 10.0]),
    ("S", {"op": "seq", "ops": [{"op": "seq", "ops": [{"op": "count"}]}, {"op": "const", "value": "x"}]}, [10.0, "x"]),
    ("S", {"op": "seq", "ops": [{"op": "count"}, {"op": "nope"}]}, None),
    ("S", {"op": "seq", "ops": []}, None),
    ("S", {"op": "nope"}, None),
]


@pytest.fixture(scope="module")
def results(spark):
    cells = cut(grid.parse_cells(spark.createDataFrame(list(TABLES.items()), "table_id string, html string")), "cells")
    tcols, tcells = (cut(x, "typed") for x in grid.typed(cells))
    asked = spark.createDataFrame([(f"q{i}", t, json.dumps(op, ensure_ascii=False)) for i, (t, op, _) in enumerate(CASES)] + [("bad", "S", "no json")], "question_id string, table_id string, op_json string")
    return {r["question_id"]: r for r in table_ops.execute(asked, tcols, tcells).collect()}


def plain(v):
    return v["num"] if v["kind"] == "num" else v["text"]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_operator(results, i):
    want, got = CASES[i][2], results[f"q{i}"]
    if want is None:
        assert got["error"] and got["value"] is None and got["items"] is None
    else:
        assert not got["error"]
        assert ([plain(v) for v in got["items"]] if isinstance(want, list) else plain(got["value"])) == want


def test_what_is_no_json_is_an_error(results):
    assert results["bad"]["error"]


def test_large_sums_and_cells_keep_their_cents(spark):
    table = html("项|1995|1996\n甲|9,876,543,210.12|12,345,678,901.23\n乙|2,345,678,901.35|0.1")
    tcols, tcells = grid.typed(cut(grid.parse_cells(spark.createDataFrame([("t", table)], "table_id string, html string")), "cells"))
    op = {"op": "seq", "ops": [{"op": "sum", "col": "1995"}, {"op": "cell", **ref("甲", "1996")}, {"op": "diff", "a": ref("甲", "1996"), "b": ref("乙", "1996")}]}
    asked = spark.createDataFrame([("q", "t", json.dumps(op, ensure_ascii=False))], "question_id string, table_id string, op_json string")
    assert [v["num"] for v in table_ops.execute(asked, tcols, tcells).first()["items"]] == [12222222111.47, 12345678901.23, 12345678901.13]
