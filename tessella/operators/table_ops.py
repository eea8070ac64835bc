"""The table query language: 17 operators on fuzzy row and column names.

A query is a JSON object with ``op`` and arguments; ``seq`` nests. All queries
over all tables run together: the objects become nodes, names are resolved by
two ranked joins inside each table, and every family of operators is one plan
over (nodes, typed cells). A failing operator is a row with an error, never an exception.

Nodes are keyed by ``node`` (question id and path). A value is struct(kind,
num, is_int, text); a result has a scalar value or an array of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import cut

KINDS = ["cell", "cells", "diff", "sum", "avg", "count", "subitems", "nonzero", "ratio_sum", "contains", "argmax", "argmin", "rowmax", "rowmin", "colcount", "const", "seq"]
VALUE = "struct<kind:string,num:double,is_int:boolean,text:string>"
RESULT = f"node string, value {VALUE}, items array<{VALUE}>, error string"


def _value(num=None, text=None, is_int=None):
    kind = F.lit("num") if num is not None else F.lit("text")
    null = F.lit(None)
    whole = is_int if is_int is not None else (num == F.floor(num) if num is not None else null.cast("boolean"))
    return F.struct(kind.alias("kind"), (num if num is not None else null).cast("double").alias("num"), whole.alias("is_int"), (text if text is not None else null.cast("string")).alias("text"))


def _result(node, value=None, items=None, error=None):
    none = F.lit(None)
    return [
        node.alias("node"),
        (value if value is not None else none.cast(VALUE)).alias("value"),
        (items if items is not None else none.cast(f"array<{VALUE}>")).alias("items"),
        (error if error is not None else none.cast("string")).alias("error"),
    ]


def nodes(queries: DataFrame) -> tuple[DataFrame, set[str]]:
    """Operator objects of ``queries`` (question_id, table_id, op_json), with ``seq`` unrolled, and the operators that occur.

    Columns: node, question_id, table_id, path, op, arg (VARIANT), bad. Code fences
    around the JSON go. Nesting is unrolled as deep as the text of any query goes.
    """
    said = X.strip_fence(F.col("op_json"))
    rows = queries.select("question_id", "table_id", F.array().cast("array<int>").alias("path"), F.try_parse_json(said).alias("arg"))
    named = F.regexp_extract_all("op_json", F.lit(r'"op"\s*:\s*"(\w+)"'), F.lit(1))
    seen = queries.select(F.size(F.filter(named, lambda k: k == "seq")).alias("deep"), F.explode_outer(F.array_distinct(named)).alias("k"))
    found = dict(seen.where(F.col("k").isin(KINDS)).groupBy("k").agg(F.max("deep")).collect())  # a row for each operator
    op = F.try_variant_get("arg", "$.op", "string")
    out, level = [], rows.withColumn("op", op)
    for _ in range(max(found.values(), default=0)):
        out.append(level)
        below = level.where("op = 'seq'").select("question_id", "table_id", "path", F.posexplode(F.try_variant_get("arg", "$.ops", "array<variant>")).alias("i", "arg"))
        level = below.select("question_id", "table_id", F.concat("path", F.array("i")).alias("path"), "arg").withColumn("op", op)
    out.append(level)
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    node = F.concat(F.col("question_id"), F.lit("/"), F.array_join(F.transform("path", lambda i: i.cast("string")), "."))
    known = F.coalesce(F.col("op").isin(KINDS), F.lit(False))
    return whole.select(node.alias("node"), "question_id", "table_id", "path", "op", "arg", F.when(~known, F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).alias("bad")), set(found)


def labels(tcells: DataFrame) -> DataFrame:
    """Text of each row's first cell."""
    return tcells.where("c = 0").select("table_id", "r", X.label(F.col("kind"), F.col("num"), F.col("is_int"), F.col("text")).alias("label"))


def resolve_rows(needles: DataFrame, first: DataFrame) -> DataFrame:
    """Row of each (table_id, needle): the last equal label, else the last that contains it."""
    want = X.strip(F.col("needle"))
    met = needles.select("table_id", "needle").distinct().join(first, "table_id").where(F.contains("label", want))
    rank = Window.partitionBy("table_id", "needle").orderBy((F.col("label") == want).desc(), F.col("r").desc())
    return met.withColumn("_n", F.row_number().over(rank)).where("_n = 1").select("table_id", "needle", "r")


def resolve_columns(needles: DataFrame, tcols: DataFrame) -> DataFrame:
    """Column of each (table_id, needle): the first equal name, else the first that contains it."""
    want = X.strip(F.col("needle"))
    met = needles.select("table_id", "needle").distinct().join(tcols, "table_id").where(F.contains("col_name", want))
    rank = Window.partitionBy("table_id", "needle").orderBy((X.strip(F.col("col_name")) == want).desc(), F.col("c"))
    return met.withColumn("_n", F.row_number().over(rank)).where("_n = 1").select("table_id", "needle", "c", "col_name")


def _text_arg(name: str):
    return F.coalesce(F.try_variant_get("arg", f"$.{name}", "string"), F.lit(""))


def _list_arg(name: str):
    return F.coalesce(F.try_variant_get("arg", f"$.{name}", "array<string>"), F.array().cast("array<string>"))


def execute(queries: DataFrame, tcols: DataFrame, tcells: DataFrame) -> DataFrame:
    """Result of every query: question_id, value, items, error (just one of the last three is set).

    Every table's cells are read once for each family of operators that occurs;
    joins are on table_id (and row or column), which all inputs can be partitioned by.
    """
    n, kinds = nodes(queries)
    n = cut(n.withColumn("arg", F.to_json("arg")), "nodes").withColumn("arg", F.try_parse_json("arg"))
    first = labels(tcells)
    families = [
        ({"const"}, lambda: _constants(n)),
        ({"cell", "cells", "diff", "sum", "avg"}, lambda: _references(n, tcols, tcells, first)),
        ({"sum", "avg", "ratio_sum"}, lambda: _columns(n, tcols, tcells, first)),
        ({"count", "contains"}, lambda: _counts(n, tcols, tcells)),
        ({"colcount"}, lambda: _colcounts(n, tcols, tcells)),
        ({"argmax", "argmin"}, lambda: _extremes(n, tcols, tcells)),
        ({"rowmax", "rowmin"}, lambda: _row_extremes(n, tcols, tcells, first)),
        ({"nonzero"}, lambda: _nonzero(n, tcols, tcells, first)),
        ({"subitems"}, lambda: _subitems(n, tcells, first)),
    ]
    flat = n.where("bad IS NOT NULL").select(*_result(F.col("node"), error=F.col("bad")))
    for uses, plan in families:
        if uses & kinds:
            flat = flat.union(plan())
    return _compose(n, cut(flat, "results"))


def _compose(n: DataFrame, flat: DataFrame) -> DataFrame:
    """Put ``seq`` lists together, inner ones first; one failing child fails the list."""
    held = n.select("node", "question_id", "path", "op").join(flat, "node", "left")
    own = F.when(F.col("op") == "seq", F.lit(None)).otherwise(F.coalesce("error", F.when(F.col("value").isNull() & F.col("items").isNull(), F.lit("no result"))))
    leaf = F.struct("path", F.col("op").alias("op"), "value", "items", own.alias("error"))
    lists = held.groupBy("question_id").agg(F.array_sort(F.collect_list(leaf)).alias("all"))  # the nodes of one query
    root = F.filter("all", lambda x: F.size(x["path"]) == 0)[0]
    children = F.filter("all", lambda x: (F.size(x["path"]) > 0) & (x["op"] != "seq"))
    failed = F.filter("all", lambda x: x["error"].isNotNull())
    flatten = F.flatten(F.transform(children, lambda x: F.coalesce(x["items"], F.array(x["value"]))))
    is_seq = root["op"] == "seq"
    empty = F.exists("all", lambda x: (x["op"] == "seq") & ~F.exists("all", lambda y: (F.size(y["path"]) == F.size(x["path"]) + 1) & (F.slice(y["path"], 1, F.size(x["path"])) == x["path"])))
    error = F.when(empty, F.lit("seq without ops")).otherwise(F.try_element_at(F.transform(failed, lambda x: x["error"]), F.lit(1)))
    rows = lists.select("question_id", error.alias("error"), F.when(~is_seq, root["value"]).alias("value"), F.when(is_seq, flatten).otherwise(root["items"]).alias("items"))
    return rows.select("question_id", F.when(F.col("error").isNull(), F.col("value")).alias("value"), F.when(F.col("error").isNull(), F.col("items")).alias("items"), "error")


def _constants(n: DataFrame) -> DataFrame:
    rows = n.where("op = 'const'")
    kind = F.schema_of_variant(F.try_variant_get("arg", "$.value", "variant"))
    num, text = F.try_variant_get("arg", "$.value", "double"), F.try_variant_get("arg", "$.value", "string")
    array = F.try_variant_get("arg", "$.value", "array<string>")
    is_text = kind == "STRING"
    value = F.when(~is_text & num.isNotNull() & ~kind.startswith("BOOLEAN"), _value(num=num, is_int=(num == F.floor(num)) & ~F.contains(text, F.lit(".")))).when(text.isNotNull() & (text != ""), _value(text=text))
    items = F.when(kind.startswith("ARRAY"), F.transform(array, lambda t: _value(text=t)))
    missing = kind.isNull() | kind.isin("VOID") | (is_text & (text == ""))
    return rows.select(*_result(F.col("node"), F.when(~missing & items.isNull(), value), F.when(~missing, items), F.when(missing, F.lit("const without value"))))


_REF = "struct<row:string,col:string>"


def _references(n: DataFrame, tcols: DataFrame, tcells: DataFrame, first: DataFrame) -> DataFrame:
    """cell, cells, diff, and sum and avg over references."""
    ref = lambda at: F.try_variant_get("arg", at, _REF)
    listed = F.try_variant_get("arg", "$.refs", f"array<{_REF}>")
    refs = (
        F.when(F.col("op") == "cell", F.array(ref("$")))
        .when(F.col("op") == "diff", F.array(ref("$.a"), ref("$.b")))
        .when(F.col("op").isin("cells") | (F.col("op").isin("sum", "avg") & (F.size(listed) > 0)), listed)
    )
    rows = n.select("node", "op", "table_id", refs.alias("refs")).where("op IN ('cell', 'cells', 'diff') OR refs IS NOT NULL")
    each = rows.select("node", "op", "table_id", F.posexplode_outer("refs").alias("i", "ref")).select("node", "op", "table_id", "i", F.coalesce("ref.row", F.lit("")).alias("row"), F.coalesce("ref.col", F.lit("")).alias("col"))
    got = each.join(resolve_rows(each.select("table_id", F.col("row").alias("needle")), first).withColumnRenamed("needle", "row"), ["table_id", "row"], "left")
    got = got.join(resolve_columns(each.select("table_id", F.col("col").alias("needle")), tcols).withColumnRenamed("needle", "col"), ["table_id", "col"], "left")
    value = F.struct("kind", "num", "is_int", "text")
    full = ~X.is_empty(F.col("kind"), F.col("text"))
    at = tcells.select("table_id", "r", "c", F.when(full, value).alias("v"))
    instead = tcells.where("kind = 'num'").groupBy("table_id", "r").agg(F.min_by(value, "c").alias("alt"))
    got = got.join(at, ["table_id", "r", "c"], "left").join(instead, ["table_id", "r"], "left")
    lost = F.col("r").isNull() | F.col("c").isNull()
    v = F.when(~lost, F.coalesce("v", "alt"))
    error = F.when(F.col("i").isNull(), F.lit("no refs")).when(lost, F.format_string("not found: row=%s col=%s", "row", "col")).when(v.isNull(), F.format_string("empty cell: %s x %s", "row", "col"))
    error = F.coalesce(error, F.when(F.col("op").isin("diff", "sum", "avg") & (v["kind"] != "num"), F.concat(F.lit("not a number: "), F.coalesce(v["text"], F.lit("")))))
    clean = F.struct(v["kind"].alias("kind"), X.denoise(v["num"]).alias("num"), v["is_int"].alias("is_int"), v["text"].alias("text"))
    listed = got.select("node", "op", "i", clean.alias("v"), error.alias("error")).groupBy("node", "op").agg(
        F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("i"))).alias("e1"), F.max("error").alias("e2")
    )  # the references of one node
    one, nums = F.col("vs")[0]["v"], F.transform("vs", lambda x: x["v"]["num"])
    total = F.aggregate(nums, F.lit(0.0), lambda s, x: s + x)
    whole = F.forall("vs", lambda x: x["v"]["is_int"])
    difference = _value(num=X.denoise(F.get(nums, 0) - F.get(nums, 1)))
    value = (
        F.when(F.col("op") == "cell", one)
        .when(F.col("op") == "diff", difference)
        .when(F.col("op") == "sum", _value(num=X.denoise(total)))
        .when(F.col("op") == "avg", _value(num=X.denoise(total / F.size(nums))))
    )
    bad = F.coalesce("e1", "e2")
    return listed.select(*_result(F.col("node"), F.when(bad.isNull(), value), F.when(bad.isNull() & (F.col("op") == "cells"), F.transform("vs", lambda x: x["v"])), bad))


def _columns(n: DataFrame, tcols: DataFrame, tcells: DataFrame, first: DataFrame) -> DataFrame:
    """sum and avg of a column, ratio_sum of two; over named rows or all. A row named twice counts twice."""
    refs = F.size(F.coalesce(F.try_variant_get("arg", "$.refs", f"array<{_REF}>"), F.array().cast(f"array<{_REF}>")))
    rows = n.where(F.col("op").isin("sum", "avg", "ratio_sum")).where((F.col("op") == "ratio_sum") | (refs == 0))
    slots = F.when(F.col("op") == "ratio_sum", F.array(_text_arg("num_col"), _text_arg("den_col"))).otherwise(F.array(_text_arg("col")))
    each = rows.select("node", "op", "table_id", _list_arg("rows").alias("rows"), F.posexplode(slots).alias("slot", "needle"))
    col = each.join(resolve_columns(each.select("table_id", "needle"), tcols), ["table_id", "needle"], "left")
    named = rows.select("node", "table_id", F.explode(_list_arg("rows")).alias("needle"))
    found = named.join(resolve_rows(named, first), ["table_id", "needle"], "left")
    lost = found.groupBy("node").agg(F.bool_or(F.col("r").isNull()).alias("lost"))
    numbers = tcells.where("kind = 'num'").select("table_id", "r", "c", "num")
    some = col.where(F.size("rows") > 0).join(found.select("node", "r"), "node").join(numbers, ["table_id", "r", "c"]).select("node", "slot", "num")
    every = col.where((F.size("rows") == 0) & (F.col("op") != "ratio_sum")).join(numbers, ["table_id", "c"]).select("node", "slot", "num")
    sums = some.union(every).groupBy("node", "slot").agg(F.sum(F.col("num").cast("decimal(38,10)")).cast("double").alias("s"), F.count("*").alias("k"))
    state = col.join(sums, ["node", "slot"], "left").join(lost, "node", "left")
    state = state.groupBy("node", "op").agg(
        F.bool_or("lost").alias("lost"),
        F.bool_or(F.col("c").isNull()).alias("no_col"),
        F.bool_or(F.col("k").isNull()).alias("no_num"),
        F.max(F.when(F.col("slot") == 0, F.col("s"))).alias("a"),
        F.max(F.when(F.col("slot") == 1, F.col("s"))).alias("b"),
        F.max(F.when(F.col("slot") == 0, F.col("k"))).alias("k"),
    )
    ratio = F.col("op") == "ratio_sum"
    error = (
        F.when(F.col("lost"), F.lit("row not found"))
        .when(F.col("no_col"), F.lit("column not found"))
        .when(F.col("no_num"), F.lit("no numbers"))
        .when(ratio & (F.col("b") == 0), F.lit("denominator is 0"))
    )
    number = F.when(ratio, X.round_half_even(100 * F.try_divide(F.col("a"), F.col("b")), 2)).when(F.col("op") == "avg", X.denoise(F.try_divide(F.col("a"), F.col("k")))).otherwise(X.denoise(F.col("a")))
    return state.select(*_result(F.col("node"), F.when(error.isNull(), _value(num=number)), None, error))


def _shown(cells: DataFrame) -> DataFrame:
    """Non-empty cells with their text."""
    return cells.where(~X.is_empty(F.col("kind"), F.col("text"))).withColumn("shown", X.label(F.col("kind"), F.col("num"), F.col("is_int"), F.col("text")))


def _counts(n: DataFrame, tcols: DataFrame, tcells: DataFrame) -> DataFrame:
    """count and contains."""
    cells = _shown(tcells)
    rows = n.where("op = 'count'").select("node", "table_id", X.strip(_text_arg("contains")).alias("find"), X.strip(_text_arg("col")).alias("needle"))
    col = rows.join(resolve_columns(rows.where("needle <> ''").select("table_id", "needle"), tcols).select("table_id", "needle", "c"), ["table_id", "needle"], "left")
    col = col.withColumn("at", F.when((F.col("needle") == "") | (F.col("find") == ""), 0).otherwise(F.col("c")))
    head = tcols.where("c = 0").select("table_id", F.regexp_replace("col_name", r"(?U)\s", "").alias("head"))
    met = col.join(head, "table_id", "left").join(cells.select("table_id", F.col("c").alias("at"), "shown"), ["table_id", "at"], "left")
    hit = F.when(F.col("find") == "", F.col("shown").isNotNull() & (F.regexp_replace("shown", r"(?U)\s", "") != F.coalesce("head", F.lit("")))).otherwise(X.count_match(F.col("shown"), F.col("find")))
    done = met.groupBy("node", "find", "needle").agg(F.count_if(hit).alias("k"), F.bool_or((F.col("needle") != "") & F.col("c").isNull()).alias("lost"))
    error = F.when(F.col("lost"), F.lit("column not found")).when((F.col("find") != "") & (F.col("k") == 0), F.concat(F.lit("nothing matches: "), F.col("find")))
    counted = done.select(*_result(F.col("node"), F.when(error.isNull(), _value(num=F.col("k").cast("double"))), None, error))
    asks = n.where("op = 'contains'").select("node", "table_id", X.strip(_text_arg("text")).alias("find"))
    seen = asks.join(cells.select("table_id", "shown"), "table_id", "left").groupBy("node", "find").agg(F.bool_or(X.count_match(F.col("shown"), F.col("find"))).alias("yes"))
    error = F.when(F.col("find") == "", F.lit("contains without text"))
    answer = F.when(F.coalesce("yes", F.lit(False)), F.lit("是")).otherwise(F.lit("否"))
    return counted.union(seen.select(*_result(F.col("node"), F.when(error.isNull(), _value(text=answer)), None, error)))


def _colcounts(n: DataFrame, tcols: DataFrame, tcells: DataFrame) -> DataFrame:
    asks = n.where("op = 'colcount'").select("node", "table_id", F.coalesce(F.try_variant_get("arg", "$.match", "string"), F.lit("✅")).alias("find"))
    cols = asks.join(tcols.where("c >= 1"), "table_id", "left")
    met = cols.join(_shown(tcells).select("table_id", "c", "shown"), ["table_id", "c"], "left").groupBy("node", "find", "c", "col_name").agg(F.count_if(X.count_match(F.col("shown"), F.col("find"))).alias("k"))
    best = met.groupBy("node", "find").agg(F.max_by("col_name", F.struct("k", -F.col("c"))).alias("name"), F.max("k").alias("k"))
    error = F.when(F.coalesce("k", F.lit(0)) == 0, F.concat(F.lit("nothing matches: "), F.col("find")))
    return best.select(*_result(F.col("node"), F.when(error.isNull(), _value(text=F.col("name"))), None, error))


def _extremes(n: DataFrame, tcols: DataFrame, tcells: DataFrame) -> DataFrame:
    """argmax and argmin: the row's name; totals are left out, the first of equals wins."""
    asks = n.where("op IN ('argmax', 'argmin')").select("node", "op", "table_id", _text_arg("col").alias("needle"), F.filter(_list_arg("rows"), lambda x: X.strip(x) != "").alias("rows"))
    col = asks.join(resolve_columns(asks.select("table_id", "needle"), tcols), ["table_id", "needle"], "left")
    shown = F.when(~X.is_empty(F.col("kind"), F.col("text")), X.label(F.col("kind"), F.col("num"), F.col("is_int"), F.col("text"))).otherwise("")
    names = tcells.where("c <= 1").groupBy("table_id", "r").agg(
        F.max(F.when(F.col("c") == 0, shown)).alias("first"), F.coalesce(F.max(F.when(F.col("c") == 1, shown)), F.lit("")).alias("second"), F.coalesce(F.bool_or((F.col("c") == 1) & (F.col("kind") == "text")), F.lit(False)).alias("worded")
    )
    met = col.join(tcells.where("kind = 'num'").select("table_id", "c", "r", "num"), ["table_id", "c"]).join(names, ["table_id", "r"])
    met = met.withColumn("name", F.when(F.col("first") != "", F.col("first")).otherwise(F.col("second")))
    met = met.where((F.col("name") != "") & ~F.col("name").rlike(r"(?U)(合计|总计)\s*$"))
    met = met.where((F.size("rows") == 0) | F.exists("rows", lambda w: F.contains("first", w) | F.contains("second", w)))
    met = met.withColumn("name", F.when((F.size("rows") > 0) & (F.col("second") != "") & (F.col("second") != F.col("first")) & F.col("worded"), F.col("second")).otherwise(F.col("name")))
    order = F.struct(F.when(F.col("op") == "argmax", F.col("num")).otherwise(-F.col("num")), -F.col("r"))
    best = met.groupBy("node").agg(F.max_by("name", order).alias("name"))
    done = col.select("node", "c").join(best, "node", "left")
    error = F.when(F.col("c").isNull(), F.lit("column not found")).when(F.col("name").isNull(), F.lit("no numbers"))
    return done.select(*_result(F.col("node"), F.when(error.isNull(), _value(text=F.col("name"))), None, error))


def _row_extremes(n: DataFrame, tcols: DataFrame, tcells: DataFrame, first: DataFrame) -> DataFrame:
    """rowmax and rowmin: the column's name, or its year where a row of the table holds years."""
    asks = n.where("op IN ('rowmax', 'rowmin')").select("node", "op", "table_id", _text_arg("row").alias("needle"))
    row = asks.join(resolve_rows(asks.select("table_id", "needle"), first), ["table_id", "needle"], "left")
    met = row.join(tcells.where("kind = 'num' AND c >= 1").select("table_id", "r", "c", "num"), ["table_id", "r"])
    order = F.struct(F.when(F.col("op") == "rowmax", F.col("num")).otherwise(-F.col("num")), -F.col("c"))
    best = met.groupBy("node", "table_id").agg(F.max_by("c", order).alias("c")).join(tcols, ["table_id", "c"])
    year = tcells.where("c >= 1").withColumn("year", X.year_like(F.col("kind"), F.col("num"), F.col("text")))
    rows = year.groupBy("table_id", "r").agg(F.count_if("year").alias("k")).where("k >= 3").select("table_id", "r")
    shown = F.when(F.col("kind") == "num", X.digits(F.col("num"), "0")).otherwise(X.strip(F.col("text")))
    years = year.join(rows, ["table_id", "r"]).where("year").groupBy("table_id", "c").agg(F.min_by(shown, "r").alias("label"))
    done = row.select("node", "r").join(best.join(years, ["table_id", "c"], "left").select("node", "col_name", "label"), "node", "left")
    error = F.when(F.col("r").isNull(), F.lit("row not found")).when(F.col("col_name").isNull(), F.lit("no numbers"))
    return done.select(*_result(F.col("node"), F.when(error.isNull(), _value(text=F.coalesce("label", "col_name"))), None, error))


def _nonzero(n: DataFrame, tcols: DataFrame, tcells: DataFrame, first: DataFrame) -> DataFrame:
    asks = n.where("op = 'nonzero'").select("node", "table_id", _text_arg("col").alias("needle"), _text_arg("after_row").alias("anchor"))
    col = asks.join(resolve_columns(asks.select("table_id", "needle"), tcols).select("table_id", "needle", "c"), ["table_id", "needle"], "left")
    rows = resolve_rows(asks.where("anchor <> ''").select("table_id", F.col("anchor").alias("needle")), first)
    state = col.join(rows.select("table_id", F.col("needle").alias("anchor"), F.col("r").alias("after")), ["table_id", "anchor"], "left")
    numbers = tcells.where((F.col("kind") == "num") & (F.abs("num") > 1e-12)).select("table_id", "c", "r").join(first, ["table_id", "r"])
    met = state.join(numbers.where("label <> ''"), ["table_id", "c"]).where("r > coalesce(after, -1)")
    listed = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("found"))
    done = state.join(listed, "node", "left")
    error = F.when(F.col("c").isNull(), F.lit("column not found")).when((F.col("anchor") != "") & F.col("after").isNull(), F.lit("anchor row not found"))
    items = F.coalesce(F.transform("found", lambda x: _value(text=x["label"])), F.array().cast(f"array<{VALUE}>"))
    return done.select(*_result(F.col("node"), None, F.when(error.isNull(), items), error))


def _subitems(n: DataFrame, tcells: DataFrame, first: DataFrame) -> DataFrame:
    """subitems: zones, stops and breaks are running columns over the rows below each target.

    ``其中：`` begins a zone with the note and filledness of its row; the rows after it belong to the
    zone until the first that differs in one of them or is an addend (加：, 减：). Listing ends at the
    first heading of the target's level or total. A section lists what is in no zone. An item lists
    its zones and, in between, rows without values, and ends at the first row with a value outside them.
    """
    asks = n.where("op = 'subitems'").select("node", "table_id", _text_arg("item").alias("needle"))
    target = asks.join(resolve_rows(asks.select("table_id", "needle"), first), ["table_id", "needle"], "left")
    target = target.join(first, ["table_id", "r"], "left").withColumn("own", F.coalesce(X.boundary_level(F.col("label")), F.lit(0)))
    full = ~X.is_empty(F.col("kind"), F.col("text"))
    facts = tcells.groupBy("table_id", "r").agg(
        F.max(F.when((F.col("c") == 1) & full, X.label(F.col("kind"), F.col("num"), F.col("is_int"), F.col("text")))).alias("note"), F.coalesce(F.bool_or((F.col("c") >= 1) & full), F.lit(False)).alias("filled")
    )
    lines = facts.join(first, ["table_id", "r"]).where("label <> ''").select("table_id", F.col("r").alias("line"), F.col("label").alias("name"), F.struct(F.col("note"), F.col("filled")).alias("look"))
    below = target.select("node", "table_id", "r", "own").join(lines, "table_id").where("line > r")

    so_far = Window.partitionBy("node").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    in_zone = Window.partitionBy("node", "zone").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ends = (X.boundary_level(F.col("name")) >= F.greatest("own", F.lit(1))) | F.col("name").rlike(r"(?U)(合计|总计)\s*$")
    listed = below.withColumn("over", F.bool_or(ends).over(so_far)).where("NOT over").withColumn("opens", F.col("name").startswith("其中："))
    listed = listed.withColumn("zone", F.sum(F.col("opens").cast("int")).over(so_far)).withColumn("like", F.last(F.when(F.col("opens"), F.col("look")), ignorenulls=True).over(so_far))
    strays = ~F.col("opens") & (~F.col("look").eqNullSafe(F.col("like")) | F.col("name").rlike("^[加减][：:]"))
    listed = listed.withColumn("outside", (F.col("zone") == 0) | F.bool_or(strays).over(in_zone))
    listed = listed.withColumn("closed", F.bool_or(F.col("outside") & F.col("look.filled")).over(so_far))
    said = F.when(F.col("own") > 0, F.when(F.col("outside") & ~F.col("opens"), F.col("name"))).when(~F.col("closed"), F.when(F.col("opens"), F.nullif(X.strip(F.substring("name", 4, 1 << 20)), F.lit(""))).otherwise(F.col("name")))
    found = listed.withColumn("said", said).where("said IS NOT NULL").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("line", "said"))).alias("found"))  # rows of one table
    done = target.select("node", "r").join(found, "node", "left")
    items = F.coalesce(F.transform("found", lambda x: _value(text=x["said"])), F.array().cast(f"array<{VALUE}>"))
    error = F.when(F.col("r").isNull(), F.lit("item not found"))
    return done.select(*_result(F.col("node"), None, F.when(error.isNull(), items), error))
