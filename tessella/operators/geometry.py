"""Words on a page to rows and columns: words(page_id, x0, x1, top, bottom, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Labels that are no title.
STOP_LABELS = ["期末余额", "期初余额", "单位：元", "单位:元"]


def degenerate(n_cols: Column, n_rows: Column) -> Column:
    return (n_cols <= 1) & (n_rows >= 4)


def title(lines: DataFrame, window: float = 36.0) -> DataFrame:
    """Title above each table: lines(table_id, top, text, table_top) in the window above it.

    From the bottom up, the first numbered line of at most 40 characters; else the lowest
    line unless it is long, only digits, a stop label or a note.
    """
    t = X.strip(F.col("text"))
    near = lines.where((F.col("top") < F.col("table_top")) & (F.col("top") >= F.col("table_top") - window)).withColumn("t", t)
    numbered = F.col("t").rlike(r"^\d+[．.]") & (F.length("t") <= 40)
    best = near.groupBy("table_id").agg(F.max_by("t", F.when(numbered, F.col("top"))).alias("numbered"), F.max_by("t", "top").alias("last"))
    unfit = (F.length("last") > 40) | F.col("last").rlike(r"^[\d\s]*$") | F.col("last").isin(STOP_LABELS) | F.col("last").rlike("^(注释|注：|注:)")
    return best.select("table_id", F.coalesce("numbered", F.when(~unfit, F.col("last"))).alias("title"))


def nearest_rows(words: DataFrame, rows: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Row of each word by the nearest centre within ``tolerance``: page_id, word_id, row_no.

    An equi-join on the page and on bands of the tolerance's height, so a word meets the rows of three bands only.
    """
    centre = (F.col("top") + F.col("bottom")) / 2
    w = words.select("page_id", "word_id", centre.alias("y")).withColumn("band", F.floor(F.col("y") / tolerance))
    r = rows.select("page_id", "row_no", centre.alias("ry")).withColumn("band", F.explode(F.array(*(F.floor(F.col("ry") / tolerance) + d for d in (-1, 0, 1)))))
    met = w.join(r, ["page_id", "band"]).withColumn("d", F.abs(F.col("y") - F.col("ry"))).where(F.col("d") <= tolerance)
    return met.groupBy("page_id", "word_id").agg(F.min_by("row_no", F.struct("d", "row_no")).alias("row_no"))


def side_columns(words: DataFrame, rows: DataFrame, left: float, right: float, tolerance: float = 15.0) -> DataFrame:
    """Stray words beside a table as columns of its rows: page_id, side, row_no, text; a side counts if it covers two rows and half of all."""
    side = F.when(F.col("x1") <= left + 2, "left").when(F.col("x0") >= right - 2, "right")
    stray = words.withColumn("side", side).where("side IS NOT NULL")
    placed = stray.join(nearest_rows(stray, rows, tolerance), ["page_id", "word_id"])
    texts = placed.groupBy("page_id", "side", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    need = rows.groupBy("page_id").agg(F.greatest(F.lit(2), F.floor(F.count("*") / 2)).alias("need"))
    covered = texts.groupBy("page_id", "side").agg(F.count("*").alias("k")).join(need, "page_id").where("k >= need")
    return texts.join(covered.select("page_id", "side"), ["page_id", "side"], "left_semi")


def bands(words: DataFrame, gap: float = 12.0) -> DataFrame:
    """Words with the number of their band, from 0: page_id, band, top, x0, text.

    Bands of a page begin at its first height and at each height that is ``gap`` or more below the
    beginning of the band before; a word is in the last band that begins at or above it.
    """
    heights = words.groupBy("page_id").agg(F.array_sort(F.collect_set("top")).alias("tops"))  # heights of one page
    begun = F.aggregate("tops", F.array().cast("array<double>"), lambda b, t: F.when((F.size(b) == 0) | (t - F.element_at(b, -1) >= gap), F.array_append(b, t)).otherwise(b))
    begins = heights.select("page_id", begun.alias("begins"))
    band = F.size(F.filter("begins", lambda b: b <= F.col("top"))) - 1
    return words.join(begins, "page_id").select("page_id", band.alias("band"), "top", "x0", "text")


def rebuild(words: DataFrame, gap: float = 12.0, tolerance: float = 90.0) -> DataFrame:
    """Text matrix of each page's words, without ruled lines: page_id, rows (array of arrays; null where there is none).

    The left edges of the first band of two words or more are the columns. A word belongs to the
    nearest one (of two, the left one) if it is within ``tolerance``; texts of one place are joined from left to right. A
    note that stands alone in its row is no row. Pages of fewer than three words, or without two columns, have no matrix.
    """
    placed = bands(words, gap)
    counted = placed.groupBy("page_id", "band").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("x0")).alias("xs"))
    edges = counted.groupBy("page_id").agg(F.min_by("xs", F.when(F.col("n") > 1, F.col("band"))).alias("edges"), F.sum("n").alias("words")).where("edges IS NOT NULL AND words > 2")
    near = F.array_min(F.transform("edges", lambda e, i: F.struct(F.abs(F.col("x0") - e).alias("d"), i.alias("i"))))
    own = placed.join(edges, "page_id").withColumn("near", near).withColumn("at", F.when(F.col("near.d") <= tolerance, F.col("near.i")))
    held = own.groupBy("page_id", "band").agg(F.array_sort(F.collect_list(F.struct("x0", "top", "text", "at"))).alias("words"), F.first("edges").alias("edges"))
    cell = lambda i: F.array_join(F.transform(F.filter("words", lambda w: w["at"] == i), lambda w: w["text"]), "")
    rows = held.withColumn("row", F.transform("edges", lambda _, i: cell(i)))
    lone = F.get("row", F.lit(0)).rlike("^(注释|注：|注:)") & (F.array_join(F.slice("row", 2, 1 << 20), "") == "")
    made = rows.where(~lone).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "row"))), lambda x: x["row"]).alias("rows"))
    return words.select("page_id").distinct().join(made, "page_id", "left")


def words_row(words: DataFrame, columns: DataFrame, y_lo: float, y_hi: float) -> DataFrame:
    """Words between two heights, each in the column with the nearest left edge: page_id, col_no, text (null if blank)."""
    w = words.where(((F.col("top") + F.col("bottom")) / 2).between(y_lo, y_hi)).select("page_id", "word_id", "x0", "text")
    near = w.join(columns.select("page_id", "col_no", F.col("x0").alias("cx")), "page_id")
    rank = Window.partitionBy("page_id", "word_id").orderBy(F.abs(F.col("x0") - F.col("cx")), "col_no")
    own = near.withColumn("_n", F.row_number().over(rank)).where("_n = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda x: x["text"]), " ")
    got = own.groupBy("page_id", "col_no").agg(text.alias("text"))
    return columns.select("page_id", "col_no").join(got, ["page_id", "col_no"], "left").withColumn("text", F.nullif(X.strip(F.col("text")), F.lit("")))


def column_bounds(cells: DataFrame) -> DataFrame:
    """Left and right edges of a table's columns, from its first row: page_id, col_no, x0, x1 of cells(page_id, row_no, col_no, x0, x1)."""
    first = cells.groupBy("page_id").agg(F.min("row_no").alias("row_no"))
    return cells.join(first, ["page_id", "row_no"], "left_semi").select("page_id", "col_no", "x0", "x1")
