"""A small safe language in place of generated code: verbs on a typed table, compiled to columns.

A program is a list of steps, each a dict with one verb: filter, select, sort, head or
agg. Nothing is evaluated as code, and names are looked up, never interpolated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}
_AGGREGATE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


class ProgramError(ValueError):
    """A step that the language does not have."""


def compile_program(table: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply steps to a wide table; unknown verbs, columns or operators raise :class:`ProgramError`."""

    def column(name: str) -> Column:
        if name not in table.columns:
            raise ProgramError(f"no column {name!r}")
        return table[name]

    for step in steps:
        if len(step) != 1:
            raise ProgramError("a step has one verb")
        verb, arg = next(iter(step.items()))
        if verb == "filter":
            if arg.get("op") not in _COMPARE:
                raise ProgramError(f"no comparison {arg.get('op')!r}")
            table = table.where(_COMPARE[arg["op"]](column(arg["col"]), F.lit(arg["value"])))
        elif verb == "select":
            table = table.select(*(column(c) for c in arg))
        elif verb == "sort":
            table = table.orderBy(*(column(c.removeprefix("-")).desc() if c.startswith("-") else column(c).asc() for c in arg))
        elif verb == "head":
            table = table.limit(int(arg))
        elif verb == "agg":
            if any(f not in _AGGREGATE for _, (f, _c) in arg.get("values", {}).items()):
                raise ProgramError("unknown aggregate")
            made = [_AGGREGATE[f](column(c)).alias(name) for name, (f, c) in arg["values"].items()]
            table = table.groupBy(*(column(c) for c in arg.get("by", []))).agg(*made)
        else:
            raise ProgramError(f"no verb {verb!r}")
    return table


def wide(tcells: DataFrame, tcols: DataFrame, table_id: str) -> DataFrame:
    """One typed table with its own columns; numbers as doubles where a column holds only them."""
    cells = tcells.where(F.col("table_id") == table_id).join(tcols, ["table_id", "c"])
    names = [r["col_name"] for r in tcols.where(F.col("table_id") == table_id).orderBy("c").collect()]  # the columns of one table
    kinds = {r[0]: r[1] for r in cells.groupBy("col_name").agg(F.bool_and(F.col("kind") != "text")).collect()}
    text = F.when(F.col("kind") == "num", F.col("num").cast("string")).otherwise(F.col("text"))
    pivoted = cells.groupBy("r").pivot("col_name", names).agg(F.first(text)).orderBy("r")
    return pivoted.select(*(F.col(f"`{n}`").cast("double").alias(n) if kinds.get(n) else F.col(f"`{n}`") for n in names))


def _run(rows: list[dict], steps: list[dict]) -> list[dict]:
    """Steps on the rows of one table, as dicts from column name to number, text or null."""
    columns = list(rows[0]) if rows else []

    def known(name: str) -> str:
        if columns and name not in columns:
            raise ProgramError(f"no column {name!r}")
        return name

    def order(row: dict, name: str):
        v = row[name]
        return (v is not None, isinstance(v, str), v if v is not None else 0)

    for step in steps:
        if not isinstance(step, dict) or len(step) != 1:
            raise ProgramError("a step has one verb")
        verb, arg = next(iter(step.items()))
        if verb == "filter":
            name, op, value = known(arg["col"]), arg.get("op"), arg["value"]
            if op not in _TEST:
                raise ProgramError(f"no comparison {op!r}")
            rows = [r for r in rows if r[name] is not None and isinstance(r[name], str) == isinstance(value, str) and _TEST[op](r[name], value)]
        elif verb == "select":
            columns = [known(c) for c in arg]
            rows = [{c: r[c] for c in columns} for r in rows]
        elif verb == "sort":
            for name in reversed(arg):
                key = known(name.removeprefix("-"))
                rows = sorted(rows, key=lambda r, key=key: order(r, key), reverse=name.startswith("-"))
        elif verb == "head":
            rows = rows[: int(arg)]
        elif verb == "agg":
            by = [known(c) for c in arg.get("by", [])]
            groups: dict[tuple, list[dict]] = {} if by else {(): rows}
            for r in rows if by else ():
                groups.setdefault(tuple(r[c] for c in by), []).append(r)
            made = []
            for key, members in groups.items():
                row = dict(zip(by, key))
                for name, (f, c) in arg["values"].items():
                    held = [r[known(c)] for r in members if r[c] is not None]
                    if f not in _AGGREGATE:
                        raise ProgramError(f"no aggregate {f!r}")
                    if f in ("sum", "avg"):
                        held = [v for v in held if not isinstance(v, str)]
                    row[name] = float(len(held)) if f == "count" else None if not held else sum(held) / (len(held) if f == "avg" else 1) if f in ("sum", "avg") else (min if f == "min" else max)(held, key=lambda v: (isinstance(v, str), v))
                made.append(row)
            rows = made
            columns = [*by, *arg["values"]]
        else:
            raise ProgramError(f"no verb {verb!r}")
    return rows


_TEST = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def run_programs(tcells: DataFrame, tcols: DataFrame, programs: DataFrame) -> DataFrame:
    """All programs over all their tables together: question_id, place, row (name to text), error.

    ``programs``: question_id, table_id, program (JSON list of steps; fences and prose around it are ignored). The value of
    a program is that of its last step. A program that fails gives one row with an error; one without rows gives none. The
    rows of one table are one task's value.
    """
    ship(tcells.sparkSession)
    cells = tcells.join(tcols, ["table_id", "c"]).groupBy("table_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", "col_name", "kind", "num", "text"))).alias("cells"))
    tables = cells.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("rows"))
    asked = programs.select("question_id", "table_id", F.regexp_extract("program", r"(?s)\[.*\]", 0).alias("program")).join(tables, "table_id", "left").select("question_id", "program", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for question, program, held in zip(*(b.column(c).to_pylist() for c in ("question_id", "program", "rows"))):
                rows = [{x["col_name"]: x["num"] if x["kind"] == "num" else x["text"] if x["kind"] == "text" else None for x in r["cells"]} for r in held or ()]
                try:
                    got = _run(rows, json.loads(program))
                    shown = [{k: (f"{v:.12g}" if isinstance(v, float) and abs(v) < 1e12 else repr(v)) if isinstance(v, float) else v for k, v in r.items()} for r in got]
                    out += [(question, i, list(r.items()), None) for i, r in enumerate(shown)]
                except (ProgramError, KeyError, TypeError, ValueError, AttributeError) as e:
                    out.append((question, None, None, str(e) or type(e).__name__))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["question_id", "place", "row", "error"])

    return asked.mapInArrow(run, "question_id string, place int, row map<string,string>, error string")
