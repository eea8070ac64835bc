"""Tables of pages from their words: ruled tables as they are, with columns beside them, or made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry

#: How far above and below a degenerate table its words may stand.
ABOVE, BELOW = 16.0, 14.0


def recognise_words(tables: DataFrame, words: DataFrame) -> DataFrame:
    """One table for each page that has one: page_id, how (lines or rebuilt), rows.

    ``tables``: page_id, rows (array of arrays of text), left, right, top, bottom; rows of a table are of
    one height. ``words``: page_id, word_id, x0, x1, top, bottom, text. A blank table is none. A
    degenerate one (one column, four rows or more) is made anew from the words in and just around it, and stays where they
    give no matrix. Others get the words left and right of them as columns, where those cover enough rows.
    """
    said = F.exists("rows", lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    held = tables.where(said).withColumn("flat", geometry.degenerate(F.array_max(F.transform("rows", F.size)), F.size("rows")))
    band = held.where("flat").select("page_id", (F.col("top") - ABOVE).alias("_top"), (F.col("bottom") + BELOW).alias("_bottom"))
    centre = (F.col("top") + F.col("bottom")) / 2
    near = words.join(band, "page_id").where(centre.between(F.col("_top"), F.col("_bottom")))
    anew = geometry.rebuild(near).select("page_id", F.col("rows").alias("anew"))

    ruled = held.where("NOT flat")
    height = (F.col("bottom") - F.col("top")) / F.size("rows")
    lines = ruled.select("page_id", "left", "right", "top", height.alias("h"), F.posexplode("rows").alias("row_no", "cells"))
    lines = lines.select("page_id", "left", "right", "row_no", "cells", (F.col("top") + F.col("row_no") * F.col("h")).alias("top"), (F.col("top") + (F.col("row_no") + 1) * F.col("h")).alias("bottom"))
    # The sides differ from page to page, so words are moved: a table's left edge at 0, its right edge at a common place.
    edges = ruled.select("page_id", "left", "right")
    moved = words.join(edges, "page_id").where(F.col("x1").between(-1e9, F.col("left") + 2) | (F.col("x0") >= F.col("right") - 2))
    at_left = F.col("x1") <= F.col("left") + 2
    moved = moved.withColumn("x1", F.when(at_left, F.lit(-2.0)).otherwise(F.lit(1e6))).withColumn("x0", F.when(at_left, F.col("x0") - F.col("left")).otherwise(F.col("x0") - F.col("right") + 1e6))
    sides = geometry.side_columns(moved.drop("left", "right"), lines.select("page_id", "row_no", "top", "bottom"), 0.0, 1e6)
    texts = sides.groupBy("page_id", "row_no").agg(*(F.max(F.when(F.col("side") == s, F.col("text"))).alias(f"_{s}") for s in ("left", "right")))
    has = sides.groupBy("page_id").agg(*(F.bool_or(F.col("side") == s).alias(f"_has_{s}") for s in ("left", "right")))
    placed = lines.join(texts, ["page_id", "row_no"], "left").join(has, "page_id", "left")
    extra = lambda s: F.when(F.coalesce(f"_has_{s}", F.lit(False)), F.array(F.coalesce(f"_{s}", F.lit("")))).otherwise(F.array().cast("array<string>"))
    full = placed.select("page_id", "row_no", F.concat(extra("left"), "cells", extra("right")).alias("cells"))
    whole = full.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"))

    made = held.where("flat").join(anew, "page_id", "left").select("page_id", F.when(F.col("anew").isNull(), "lines").otherwise("rebuilt").alias("how"), F.coalesce("anew", "rows").alias("rows"))
    return made.union(whole.select("page_id", F.lit("lines").alias("how"), "rows"))
