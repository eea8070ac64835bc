"""Question sheets and answer files: CSV, Parquet and XLSX (standard library only)."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def parse_xlsx(raw: bytes) -> list[list[str]]:
    """First sheet of a workbook as rows of texts; missing cells are empty."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    name = min(x for x in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x))
    rows = []
    for row in ElementTree.fromstring(book.read(name)).iterfind(".//m:row", _NS):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.iterfind("m:c", _NS)):
            letters = re.match(r"[A-Z]*", c.get("r") or "").group()
            at = sum(26**k * (ord(x) - 64) for k, x in enumerate(reversed(letters))) - 1 if letters else i
            v = c.find("m:v", _NS)
            kind = c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
            cells[at] = shared[int(text)] if kind == "s" and text else text
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def xlsx_bytes(rows: list[list[str]]) -> bytes:
    """A workbook of one sheet with all cells as texts."""

    def column(i: int) -> str:
        return (column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    body = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{column(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1)
    )
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_NS["m"]}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, head + text)
    return out.getvalue()


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with its header row as text columns and ``row_no`` (2 is the first data row, as a spreadsheet counts).

    CSV and XLSX hold one sheet a file, which is read whole by one task, since row numbers
    count through it; Parquet tables must bring their own ``row_no``.
    """
    if path.endswith(".parquet"):
        table = spark.read.parquet(path)
        return table.select("row_no", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in table.columns if c != "row_no"))
    raw = spark.read.format("binaryFile").load(path)
    if path.endswith(".xlsx"):
        rows = parse_xlsx(bytes(raw.first()["content"]))  # a sheet that people fill in by hand
        head = rows[0] if rows else []
        data = [(i, *(row + [""] * len(head))[: len(head)]) for i, row in enumerate(rows[1:], 2)]
        return spark.createDataFrame(data, T.StructType([T.StructField("row_no", T.LongType()), *(T.StructField(c, T.StringType()) for c in head)]))
    table = spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("")
    return table.select((F.monotonically_increasing_id() + 2).alias("row_no"), *table.columns)
