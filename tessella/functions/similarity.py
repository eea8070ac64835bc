"""String and vector similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence.

    The places of ``a`` are bits of one integer, and a character of ``b`` updates all of them at once: a
    clear bit marks a place where the subsequence grows.
    """
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    rest = full = (1 << len(a)) - 1
    for y in b:
        met = rest & at.get(y, 0)
        rest = (rest + met | rest - met) & full
    return len(a) - rest.bit_count()


def indel(a: str, b: str) -> float:
    """Share of characters that stay when one text is edited into the other by insertions and deletions, times 100."""
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def best_window(a: str, b: str) -> float:
    """:func:`indel` of the shorter text with its best window in the longer one, windows at the ends cut short."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(indel(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def _pairs(measure, a: pd.Series, b: pd.Series) -> pd.Series:
    """A measure of each pair, taken once for pairs that repeat."""
    known: dict[tuple[str, str], float] = {}
    return pd.Series([None if x is None or y is None else known[x, y] if (x, y) in known else known.setdefault((x, y), measure(x, y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(indel, a, b)


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(best_window, a, b)
