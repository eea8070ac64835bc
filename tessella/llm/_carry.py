"""Columns of the caller that travel through an operator.

They are kept in one struct, so no name of theirs meets a name that an operator
uses on the way; only the names of the result can clash, and that is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OWN = "_own"


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def chosen(docs: DataFrame, carry: list[str] | None, added: list[str], without: tuple[str, ...] = ()) -> list[str]:
    """Names to carry: those given, or all but ``without``; ValueError if one is a name of the result."""
    names = [c for c in docs.columns if c not in without] if carry is None else list(carry)
    if clash := {c.lower() for c in names} & {c.lower() for c in added}:
        raise ValueError(f"columns {sorted(clash)} of the documents clash with results")
    return names


def own(names: list[str]) -> Column:
    return (F.struct(*(column(c).alias(c) for c in names)) if names else F.struct(F.lit(True).alias("none"))).alias(OWN)


def field(docs: DataFrame, names: list[str]) -> T.StructField:
    """The struct's type, for the schema of an Arrow function."""
    return T.StructField(OWN, docs.select(own(names)).schema[OWN].dataType)


def unpacked(table: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    """The carried columns, then those of the result."""
    return table.select(*(F.col(OWN).getField(c).alias(c) for c in names), *added)
