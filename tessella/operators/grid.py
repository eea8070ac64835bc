"""HTML tables to cells and back.

``cells`` holds one row for each place of a grid: table_id, row (as in the
HTML), pos (counted without empty rows), col, text, rowspan, colspan and
is_anchor. Placing cells depends on all cells before them in a table, so it runs in
Python over Arrow batches, table by table; all else is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..shipping import ship

CELLS = "table_id string, row int, pos int, col int, text string, rowspan int, colspan int, is_anchor boolean"
#: Largest spans that HTML allows.
MOST_ROWS, MOST_COLUMNS = 65534, 1000
#: Places of one cell; a larger one ends with the rows that the table has.
MOST_PLACES = 1 << 20


class _Reader(HTMLParser):
    """Rows of the first table: for each <tr>, its own cells as (text parts, rowspan, colspan)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.open: list[tuple[str, object]] = []
        self.done = False

    def _close(self, tags: set[str], upto: set[str]) -> None:
        """Close open elements through the last one of ``tags``, unless one of ``upto`` is above it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                del self.open[i:]
                return
            if self.open[i][0] in upto:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.done:
            return
        if tag == "table":
            self.open.append((tag, None))
        elif not self.open:
            return
        elif tag == "tr":
            self._close({"td", "th"}, {"table"})
            self._close({"tr"}, {"table"})
            self.rows.append([])
            self.open.append((tag, self.rows[-1]))
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"table", "tr"})
            row = self.open[-1][1] if self.open[-1][0] == "tr" else None
            said = dict(attrs)
            cell = ([], _span(said.get("rowspan"), MOST_ROWS), _span(said.get("colspan"), MOST_COLUMNS))
            if row is not None:
                row.append(cell)
            self.open.append((tag, cell))
        elif tag == "br":
            self.handle_data("\n")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self._close({"table"}, set())
            self.done = not self.open
        elif tag in ("tr", "td", "th"):
            self._close({tag}, {"table"})

    def handle_data(self, data: str) -> None:
        for tag, held in self.open:
            if tag in ("td", "th"):
                held[0].append(data)


def _span(said: str | None, most: int) -> int:
    try:
        return min(most, max(1, int(said))) if said else 1
    except ValueError:
        return 1


def _tidy(parts: list[str]) -> str:
    lines = ("".join(parts)).splitlines()
    return "\n".join(x for x in (" ".join(y for y in line.replace("\t", " ").replace("　", " ").split(" ") if y).strip() for line in lines) if x)


def place(html: str | None) -> list[tuple[int, int, int, str, int, int, bool]]:
    """Grid of the first table: (row, pos, col, text, rowspan, colspan, is_anchor) in order.

    A cell starts at the first free column of its row and fills its whole span,
    over whatever stands there; spans below the last row make rows, but for cells of over
    MOST_PLACES places, which end there. Holes become empty cells of their own; rows
    without any place are left out of ``pos``; the right edge may be ragged.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    taken: dict[tuple[int, int], int] = {}
    cells = []
    for r, row in enumerate(reader.rows):
        c = 0
        for parts, down, across in row:
            while (r, c) in taken:
                c += 1
            me = len(cells)
            cells.append((r, c, _tidy(parts), down, across))
            reach = down if down * across <= MOST_PLACES else min(down, len(reader.rows) - r)
            taken.update(((r + i, c + j), me) for i in range(reach) for j in range(across))
            c += across
    width: dict[int, int] = {}
    for r, c in taken:
        width[r] = max(width.get(r, 0), c + 1)
    out = []
    for pos, r in enumerate(sorted(width)):
        for c in range(width[r]):
            if (r, c) in taken:
                row, col, text, down, across = cells[taken[r, c]]
                out.append((r, pos, c, text, down, across, (row, col) == (r, c)))
            else:
                out.append((r, pos, c, "", 1, 1, True))
    return out


def extract_tables(raw: DataFrame, *, id_col: str = "doc_id", text_col: str = "raw") -> DataFrame:
    """Tables in recognised text: ``id_col``, ``table_no`` (from 0), ``table_name`` and ``html``.

    Code fences go. The name is the last ``TABLE_NAME:`` within 200 characters
    before the first place where the same table stands; ``-`` means none. Texts without tables give no rows.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "```(?:html)?", "")
    rows = raw.select(F.col(id_col), clean.alias("_text"))
    rows = rows.select("*", F.posexplode(F.regexp_extract_all("_text", F.lit("(?si)<table.*?</table>"), F.lit(0))).alias("table_no", "html"))
    at = F.expr("position(html in _text)")
    before = F.expr("substring(_text, greatest(1, position(html in _text) - 200), position(html in _text) - greatest(1, position(html in _text) - 200))")
    name = X.strip(F.element_at(F.regexp_extract_all(before, F.lit(r"TABLE_NAME:\s*(.+)"), F.lit(1)), -1))
    return rows.select(id_col, "table_no", F.when((at > 0) & (F.try_element_at(F.regexp_extract_all(before, F.lit(r"TABLE_NAME:\s*(.+)"), F.lit(1)), F.lit(-1)).isNotNull()), F.nullif(name, F.lit("-"))).alias("table_name"), "html")


def parse_cells(tables: DataFrame, *, id_col: str = "table_id", html_col: str = "html") -> DataFrame:
    """``cells`` of every table; a null or table-less html gives none. No shuffle."""
    ship(tables.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for key, html in zip(batch.column("table_id").to_pylist(), batch.column("html").to_pylist()):
                found = place(html)
                ids += [key] * len(found)
                rows += found
                if len(rows) >= 50_000:
                    yield _batch(ids, rows)
                    ids, rows = [], []
            if rows:
                yield _batch(ids, rows)

    return tables.select(F.col(id_col).cast("string").alias("table_id"), F.col(html_col).alias("html")).mapInArrow(run, CELLS)


def _batch(ids: list[str], rows: list[tuple]) -> pa.RecordBatch:
    row, pos, col, text, down, across, anchor = zip(*rows)
    whole = pa.int32()
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), pa.array(row, whole), pa.array(pos, whole), pa.array(col, whole), pa.array(text, pa.string()), pa.array(down, whole), pa.array(across, whole), pa.array(anchor, pa.bool_())],
        ["table_id", "row", "pos", "col", "text", "rowspan", "colspan", "is_anchor"],
    )


def json_text(c: Column) -> Column:
    """A JSON string literal that keeps non-ASCII characters."""
    held = F.to_json(F.struct(c.alias("v")))
    return F.substr(held, F.lit(6), F.length(held) - 6)


def structure_json(cells: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Structure of each table as JSON: ``table_id`` and ``json``.

    ``ranges`` (table_id, row_lo, row_hi, col_lo, col_hi; nulls for none) keeps the
    anchors in the rows or in the columns where both are given, else in the one
    that is. Counts and spans are always those of the whole table.
    """
    size = cells.groupBy("table_id").agg((F.max("pos") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    anchors = cells.where("is_anchor")
    if ranges is not None:
        anchors = anchors.join(ranges, "table_id", "left")
        in_rows, in_cols = F.col("row").between(F.col("row_lo"), F.col("row_hi")), F.col("col").between(F.col("col_lo"), F.col("col_hi"))
        has_rows, has_cols = F.col("row_lo").isNotNull(), F.col("col_lo").isNotNull()
        anchors = anchors.where(F.when(has_rows & has_cols, in_rows | in_cols).when(has_rows, in_rows).when(has_cols, in_cols).otherwise(True))
    one = F.format_string('{"row": %d, "col": %d, "rowspan": %d, "colspan": %d, "text": %s}', "row", "col", "rowspan", "colspan", json_text(F.col("text")))
    listed = anchors.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", one.alias("j")))), lambda x: x["j"]), ", ").alias("held"))
    whole = F.concat(F.format_string('{"row_count": %d, "col_count": %d, "cells": [', "rows", "cols"), F.coalesce("held", F.lit("")), F.lit("]}"))
    return size.join(listed, "table_id", "left").select("table_id", whole.alias("json"))


def grid_html(cells: DataFrame) -> DataFrame:
    """HTML of each grid from its anchors: ``table_id`` and ``html``."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    spans = F.concat(F.when(F.col("rowspan") > 1, F.format_string(' rowspan="%d"', "rowspan")).otherwise(""), F.when(F.col("colspan") > 1, F.format_string(' colspan="%d"', "colspan")).otherwise(""))
    cell = F.when(F.col("is_anchor"), F.concat(F.lit("<td"), spans, F.lit(">"), F.regexp_replace(safe, "\n", "<br>"), F.lit("</td>"))).otherwise("")
    row = cells.groupBy("table_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("h")))), lambda x: x["h"]), "").alias("h"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: F.concat(F.lit("<tr>"), x["h"], F.lit("</tr>"))), "")
    return row.groupBy("table_id").agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def text_html(rows: Column) -> Column:
    """HTML of an array of rows of texts, without spans; null is empty."""
    safe = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(X.strip(F.coalesce(t, F.lit(""))), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    line = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda t: F.concat(F.lit("<td>"), safe(t), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))


def table_facts(cells: DataFrame) -> DataFrame:
    """One row a table: n_rows, n_cols, unit_note, has_data (a text beside a row's first cell, below the first row), masked, headers."""
    unit = F.regexp_extract("text", X.UNIT, 1)
    first_rows = F.struct("pos", "col")
    return cells.groupBy("table_id").agg(
        (F.max("pos") + 1).alias("n_rows"),
        (F.max("col") + 1).alias("n_cols"),
        F.min_by(F.nullif(unit, F.lit("")), F.when((F.col("pos") < 3) & (unit != ""), first_rows)).alias("unit_note"),
        F.bool_or((F.col("pos") >= 1) & (F.col("col") >= 1) & (X.strip(F.col("text")) != "")).alias("has_data"),
        F.bool_or(F.contains("text", F.lit("[MASK]")) | F.contains("text", F.lit("[UNSURE"))).alias("masked"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") == 0, F.struct("col", "text")))), lambda x: x["text"]).alias("headers"),
    )


def typed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed table: ``tcols`` (table_id, c, col_name) and ``tcells`` (table_id, r, c, kind, num, is_int, text).

    The header is the first row; a second row joins it when the table has more
    than two, that row holds no number and one of both rows has a merged cell over columns: names become
    ``parent:child``. Repeated names get ``.1``, ``.2`` in order. Short rows are filled
    with nulls and long ones cut to the header's width. One shuffle by table_id serves the
    windows of both results; a table's rows come from one HTML value and are never many.
    """
    whole = Window.partitionBy("table_id")
    cells = cells.withColumn("_number", F.when(F.col("pos") == 1, X.number(F.col("text"))))
    wide = F.bool_or(F.col("is_anchor") & (F.col("colspan") > 1) & (F.col("pos") <= 1)).over(whole)
    second = F.bool_and(F.when(F.col("pos") == 1, F.col("_number").isNull())).over(whole)
    two = F.coalesce((F.max("pos").over(whole) + 1 > 2) & wide & second, F.lit(False))
    laid = cells.select("table_id", "pos", "col", "text", F.when(two, 2).otherwise(1).alias("head"))
    base = X.strip(F.regexp_replace("text", "\n", " "))
    named = F.when(base == "", F.concat(F.lit("col"), F.col("col").cast("string"))).otherwise(base)
    above = F.max(F.when(F.col("pos") == 0, named)).over(Window.partitionBy("table_id", "col"))
    child = F.when((F.col("head") == 2) & above.isNotNull() & ~F.contains(named, above), F.concat(above, F.lit(":"), named)).otherwise(named)
    heads = laid.where("pos < head").withColumn("name", child).where(F.col("pos") == F.col("head") - 1)
    again = F.row_number().over(Window.partitionBy("table_id", "name").orderBy("col")) - 1
    tcols = heads.select("table_id", F.col("col").alias("c"), F.when(again > 0, F.concat_ws(".", "name", again.cast("string"))).otherwise(F.col("name")).alias("col_name"))
    lines = laid.where("pos >= head").groupBy("table_id", "pos", "head").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("held"))
    width = tcols.groupBy("table_id").agg(F.max("c").alias("last"))
    placed = lines.join(width, "table_id").select("table_id", (F.col("pos") - F.col("head")).alias("r"), "held", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("c"))
    text = F.nullif(F.coalesce(F.try_element_at("held", F.col("c")), F.lit("")), F.lit(""))
    read = placed.select("table_id", "r", "c", text.alias("t")).withColumn("n", X.number(F.col("t")))
    kind = F.when(F.col("t").isNull(), "null").when(F.col("n").isNotNull(), "num").otherwise("text")
    return tcols, read.select("table_id", "r", "c", kind.alias("kind"), F.col("n.num").alias("num"), F.col("n.is_int").alias("is_int"), F.when(kind == "text", X.strip(F.col("t"))).alias("text"))
