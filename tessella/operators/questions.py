"""Question sheets: cleaning, repairs and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numerals import chinese_int

# Enumerations and words of the question sheet.
TYPES = ["structure", "extract", "thinking"]
FORMATS = ["string", "number", "json_array", "json"]
THINKING = r"计算|求和|求差|比例|增长|平均|最高|最低|最大|最小|几个|多少个|排名|比较|判断|分差|合计|之和"
ARRAY_WORDS = r"数组|列表|多个值|多值|多个结果|逐一列出|按顺序列出"
NUMBER_WORDS = r"数值|数字|金额|百分比|小数|整数|数量"
_CN = r"([一二两三四五六七八九十\d]+)"


def answer_format(raw: Column) -> Column:
    """The enumeration a format text means; lists come before objects, those before numbers."""
    low = F.lower(raw)
    inferred = F.when(low.rlike(ARRAY_WORDS), "json_array").when(low.rlike("json|结构"), "json").when(low.rlike(NUMBER_WORDS), "number").otherwise("string")
    return F.when(raw.isin(FORMATS), raw).otherwise(inferred)


def question_type(raw: Column, question: Column, raw_format: Column) -> Column:
    """A valid type stays; others are inferred from the question."""
    s = X.strip(F.coalesce(raw, F.lit("")))
    return F.when(s.isin(TYPES), s).when((raw_format == "json") & question.rlike("恢复|结构"), "structure").when(question.rlike(THINKING), "thinking").otherwise("extract")


def padded_name(name: Column) -> Column:
    """58.pdf as 058.pdf; null for names of another shape."""
    s = X.strip(name)
    bare = F.regexp_extract(s, r"^(\d+)(\.\w+)$", 1)
    short = F.coalesce(F.nullif(F.ltrim(bare, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(bare != "", F.concat(F.when(F.length(short) < 3, F.lpad(short, 3, "0")).otherwise(short), F.regexp_extract(s, r"^(\d+)(\.\w+)$", 2)))


def clean(sheet: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and skipped rows of a raw sheet.

    ``sheet``: row_no and the text columns id, file_name, question_type, question,
    table_hint, answer_format. ``files``: file_name. The first row of an id counts
    (even if it is skipped later); missing files and empty questions are skipped, in this order. Repairs made are
    listed in ``repaired``. Skipped rows carry row_no, id and reason.
    """
    text = ["id", "file_name", "question_type", "question", "table_hint", "answer_format"]
    rows = sheet.select("row_no", *(F.coalesce(X.strip(F.col(c)), F.lit("")).alias(c) for c in text))
    order = F.row_number().over(Window.partitionBy("id").orderBy("row_no"))
    names = files.select("file_name").distinct()
    as_is = names.select(F.col("file_name").alias("_f"), F.lit(True).alias("_is"))
    padded = names.select(F.col("file_name").alias("_p"), F.lit(True).alias("_pad"))
    seen = rows.withColumn("_n", order).join(as_is, F.col("file_name") == F.col("_f"), "left")
    seen = seen.withColumn("_name", padded_name(F.col("file_name"))).join(padded, F.col("_name") == F.col("_p"), "left")
    reason = (
        F.when(F.col("id") == "", "empty id")
        .when(F.col("_n") > 1, "repeated id")
        .when(F.col("_is").isNull() & F.col("_pad").isNull(), "missing file")
        .when(F.col("question") == "", "empty question")
    )
    seen = seen.withColumn("reason", reason)
    name = F.when(F.col("_is"), F.col("file_name")).otherwise(F.col("_name"))
    kind, fmt = question_type(F.col("question_type"), F.col("question"), F.col("answer_format")), answer_format(F.col("answer_format"))
    marks = F.array(
        F.when(F.col("_is").isNull(), F.concat(F.lit("file_name:"), F.col("file_name"))),
        F.when(kind != F.col("question_type"), F.lit("question_type")),
        F.when(~F.col("answer_format").isin(FORMATS), F.lit("answer_format")),
    )
    good = seen.where("reason IS NULL").select(
        "row_no",
        F.col("id").alias("question_id"),
        name.alias("file_name"),
        kind.alias("question_type"),
        "question",
        F.nullif("table_hint", F.lit("")).alias("table_hint"),
        fmt.alias("answer_format"),
        F.when(F.col("answer_format") != fmt, F.col("answer_format")).alias("format_note"),
        F.filter(marks, lambda m: m.isNotNull()).alias("repaired"),
    )
    return good, seen.where("reason IS NOT NULL").select("row_no", "id", "reason")


def only(questions: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Those of the listed ids, then the first ``limit`` by row."""
    rows = questions if not ids else questions.where(F.col("question_id").isin(list(ids)))
    return rows if limit is None else rows.orderBy("row_no").limit(limit)


def parse_range(question: Column, row_spans: bool = True) -> Column:
    """Pages (from 1), rows and columns (from 0) a question asks for, as a struct of bounds.

    前N行 comes before 第N行, that before 表头; likewise for columns; a page range
    before a page. ``row_spans`` also reads 第A行到第B行 as rows A to B (off: only row A, as
    the pattern list alone would have it). ``how`` is regex, or full where nothing matched.
    """
    # The patterns of pages, rows and columns.
    patterns = {
        "pages": r"第\s*(\d+)\s*页\s*(?:到|至|-|—)\s*(\d+)\s*页", "page": r"第\s*(\d+)\s*页", "rows": rf"前\s*{_CN}\s*行", "row": rf"第\s*{_CN}\s*行",
        "span": rf"第\s*{_CN}\s*行\s*(?:到|至|-|—)\s*第?\s*{_CN}\s*行", "cols": rf"前\s*{_CN}\s*列", "col": rf"第\s*{_CN}\s*列",
    }
    find = lambda q, name, g=1: F.nullif(F.regexp_extract(q, patterns[name], g), F.lit(""))

    # Each text is found once, read once and then named: written out, every bound would repeat all patterns.
    def read(q: Column) -> Column:
        numbers = [find(q, "pages"), find(q, "pages", 2), find(q, "page"), find(q, "rows"), find(q, "row"), find(q, "span", 2) if row_spans else F.lit(None).cast("string"), find(q, "cols"), find(q, "col")]
        return F.struct(F.transform(F.array(*numbers), chinese_int).alias("n"), q.rlike("表头").alias("header"))

    def bounds(x: Column) -> Column:
        from_page, to_page, page, first, one, last, cols, col = (F.get(x["n"], i) for i in range(8))
        row_lo = F.when(first.isNotNull(), 0).when(one.isNotNull(), one - 1).when(x["header"], 0)
        row_hi = F.when(first.isNotNull(), first - 1).when(one.isNotNull(), F.coalesce(last, one) - 1).when(x["header"], 1)
        col_lo = F.when(cols.isNotNull(), 0).when(col.isNotNull(), col - 1)
        made = [F.coalesce(from_page, page).alias("page_lo"), F.coalesce(to_page, page).alias("page_hi"), row_lo.alias("row_lo"), row_hi.alias("row_hi"), col_lo.alias("col_lo"), (F.coalesce(cols, col) - 1).alias("col_hi")]
        return F.struct(*made, F.when(F.coalesce(from_page, page, row_lo, col_lo).isNotNull(), "regex").otherwise("full").alias("how"))

    return X.let(X.let(F.coalesce(question, F.lit("")), read), bounds)


def by_file(questions: DataFrame) -> DataFrame:
    """Questions by file, in order of their rows: file_name, n, question_ids."""
    listed = F.array_sort(F.collect_list(F.struct("row_no", "question_id")))
    return questions.groupBy("file_name").agg(F.count("*").alias("n"), F.transform(listed, lambda x: x["question_id"]).alias("question_ids"))


def range_from_json(reply: Column) -> Column:
    """A model's reply {page_range, row_range, col_range} as the struct of :func:`parse_range`; nulls where it has none."""
    said = F.from_json(X.json_object(reply), "page_range array<int>, row_range array<int>, col_range array<int>")
    pair = lambda name, i: F.when(F.size(said[name]) == 2, F.get(said[name], i))
    how = F.when(said.isNull(), "fallback_full").otherwise("llm")
    ends = [pair(f"{x}_range", i).alias(f"{x}_{b}") for x in ("page", "row", "col") for i, b in ((0, "lo"), (1, "hi"))]
    return F.struct(*ends, how.alias("how"))
