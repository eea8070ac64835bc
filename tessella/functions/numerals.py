"""Chinese numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(c: Column) -> Column:
    place = F.instr(F.lit("一二三四五六七八九"), c)
    return F.when(c == "两", 2).when((F.length(c) == 1) & (place > 0), place)


def chinese_int(c: Column) -> Column:
    """Decimal digits, a single numeral, or numerals around 十 (up to 99); null for others."""
    tens, ones = F.split_part(c, F.lit("十"), F.lit(1)), F.split_part(c, F.lit("十"), F.lit(2))
    around = F.when(tens == "", 1).otherwise(_digit(tens)) * 10 + F.coalesce(_digit(ones), F.lit(0))
    return F.when(c.rlike(r"^\d{1,9}$"), c.try_cast("int")).when(F.contains(c, F.lit("十")), around).otherwise(_digit(c)).cast("int")
