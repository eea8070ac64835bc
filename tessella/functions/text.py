"""Text and number cleaning as column expressions.

Java's ``\\s`` and ``trim`` know ASCII only, so every pattern that must see
full-width space carries ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "

# Dashes that stand for "no number".
DASHES = ["—", "－", "–", "-", "——", "――"]
NUMERIC = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DECIMAL_COMMA = r"^-?\d{1,3}[，,]\d{1,2}$"
GROUPED = r"-?\d{1,3}(?:[,，]\d{3})+(?:\.\d+)?"
PLAIN = r"-?\d+(?:\.\d+)?"
# Words of questions.
UNIT = r"单位[:：]\s*([万亿千百]?元|[％%])"
COMPOUND_MARKS = ["按表中顺序", "分别是", "以下字段", "依次是", "依次为", "对应的是"]
COUNTING = r"有几项|有几条|有多少|多少种|多少个|多少条|个数|项数|一共有几"
STOP_WORDS = (
    "的 了 在 是 和 与 或 对 就 都 还 也 什么 多少 哪些 哪个 如何 怎么 为 让 给 从 到 把"
    " 请问 请 一下 分别 各 及 等 以上 以下 合计 总额 总值 总"
).split()


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Column expressions have no names for parts; without this, nested cleaning steps double the
    expression at every level.
    """
    return F.get(F.transform(F.array(c), body), 0)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def halfwidth(c: Column) -> Column:
    """Full-width forms and the full-width space as ASCII."""
    return F.translate(c, _WIDE, _NARROW)


def number(c: Column) -> Column:
    """The number a cell holds as struct(num, is_int); null where it holds none.

    Parentheses negate, grouping commas and spaces go, a comma before one or two
    last digits is a decimal point, one trailing percent sign is dropped. Dashes
    and empty text are no numbers.
    """
    negated = lambda s: s.startswith("(") & s.endswith(")")

    def bare(s: Column) -> Column:
        inner = F.when(negated(s), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)
        plain = let(inner, lambda x: F.when(x.rlike(DECIMAL_COMMA), F.translate(x, "，,", "..")).otherwise(F.translate(x, ",， ", "")))
        return let(strip(F.regexp_replace(plain, "%$", "")), lambda t: F.when(t.rlike(NUMERIC) & ~s.isin(DASHES), made(s, t)))

    def made(s: Column, t: Column) -> Column:
        # As in a float, an integer keeps its kind only where no point was written.
        value = t.try_cast("double")
        whole = (value == F.floor(value)) & ~t.contains(".") & (F.abs(value) < 1e18)
        return F.struct(F.when(negated(s), -value).otherwise(value).alias("num"), whole.alias("is_int"))

    return let(strip(halfwidth(c)), bare)


def digits(num: Column, pattern: str) -> Column:
    """A number in a decimal pattern; halves go to the even digit of the exact binary value."""
    return F.call_function("format_number", num, F.lit(pattern))


def show(num: Column, is_int: Column | None = None) -> Column:
    """A number as text without exponent: integral ones without a point."""
    plain = digits(num, "0.##########")
    return F.when(num == F.floor(num), digits(num, "0")).otherwise(plain)


def label(kind: Column, num: Column, is_int: Column, text: Column) -> Column:
    """A cell's text as an operator sees it: numbers in their cleaned form, empty for null."""
    shown = F.when(is_int, digits(num, "0")).when(num == F.floor(num), F.concat(digits(num, "0"), F.lit(".0"))).otherwise(show(num))
    return F.when(kind == "num", shown).when(kind == "text", strip(text)).otherwise(F.lit(""))


def denoise(num: Column) -> Column:
    """Twelve significant digits, but four decimals at least: what sums of decimals leave behind goes, cents of large sums stay."""
    shown = F.when(F.abs(num) < 1e8, F.format_string("%.12g", num)).otherwise(F.format_string("%.4f", num))
    return F.when(num.isNull() | F.isnan(num) | (F.abs(num) == float("inf")), num).otherwise(shown.cast("double"))


def round_half_even(num: Column, places: int) -> Column:
    """Rounding of the exact binary value, as printed with so many digits."""
    return digits(num, "0." + "0" * places if places else "0").cast("double")


def is_empty(kind: Column, text: Column) -> Column:
    return (kind == "null") | ((kind == "text") & (F.lower(strip(text)).isin("", "nan")))


def year_like(kind: Column, num: Column, text: Column) -> Column:
    """An integral number from 1900 to 2099, or such a text."""
    as_number = (kind == "num") & (num >= 1900) & (num <= 2099) & (num == F.floor(num))
    return F.coalesce(as_number | ((kind == "text") & strip(text).rlike(r"^(19|20)\d{2}$")), F.lit(False))


def count_match(cell: Column, needle: Column) -> Column:
    """Equal, or one inside the other, and neither empty."""
    return (cell != "") & (needle != "") & (F.contains(cell, needle) | F.contains(needle, cell))


def boundary_level(name: Column) -> Column:
    """3 for 一、 headings, 2 for （一） headings, 1 for a trailing colon that is not 其中, else 0."""
    return (
        F.when(name.rlike("^[一二三四五六七八九十]+、"), 3)
        .when(name.rlike("^[（(][一二三四五六七八九十]+[）)]"), 2)
        .when(name.rlike(r"(?U)[:：]\s*$") & ~name.startswith("其中"), 1)
        .otherwise(0)
    )


def normalised(c: Column) -> Column:
    """Text for comparison: half-width, without white space, commas, full stops and percent signs."""
    narrow = F.translate(c, _WIDE[:-1], _NARROW[:-1])
    return F.regexp_replace(narrow, r"(?U)[\s,，。%％]", "")


def compact(c: Column) -> Column:
    """Without white space and quotation marks."""
    return F.regexp_replace(c, "(?U)[\\s　\"'“”‘’「」『』]", "")


def garbled(c: Column) -> Column:
    """Four characters or more, over half of them (white space apart) neither letters nor digits."""
    solid = F.regexp_replace(c, r"(?U)\s+", "")
    odd = F.length(F.regexp_replace(solid, r"[\p{L}\p{N}]+", ""))
    return (F.length(solid) >= 4) & (odd > 0.5 * F.length(solid))


def garbled_layer(c: Column) -> Column:
    """A text layer of 100 characters or more with over half symbols and under a quarter CJK characters and Latin words."""
    solid = F.regexp_replace(c, r"(?U)\s+", "")
    n = F.length(solid)
    symbols = F.length(F.regexp_replace(solid, r"[\p{L}\p{N}]+", ""))
    cjk = F.length(F.regexp_replace(c, r"[^一-鿿]+", ""))
    latin = F.length(F.regexp_replace(F.array_join(F.regexp_extract_all(c, F.lit(r"[A-Za-z]{2,}"), F.lit(0)), ""), r"\s", ""))
    return (n >= 100) & (symbols > 0.5 * n) & ((cjk + latin) < 0.25 * n)


def tokens(c: Column) -> Column:
    """Distinct words of two or more ASCII letters and digits, and pairs of neighbouring CJK characters (others taken out first)."""
    ascii_words = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]{2,}"), F.lit(0)), F.lower)
    pairs = let(F.regexp_replace(c, r"[^一-鿿]+", ""), lambda cjk: _grams(cjk, 2))
    return F.array_distinct(F.concat(ascii_words, pairs))


def _grams(c: Column, n: int) -> Column:
    """All runs of n characters, in order."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def query_tokens(c: Column) -> Column:
    """Parts between punctuation; a part over four characters also gives all its pairs and triples; stop words go.

    Order and repetitions are kept.
    """
    stop = F.array(*map(F.lit, STOP_WORDS))
    parts = F.filter(F.transform(F.split(c, r"(?U)[，。？；：、,\.?:;！!（）()【】\[\]\s]+"), strip), lambda p: p != "")
    pieces = F.transform(parts, lambda p: F.when(F.length(p) <= 4, F.array(p)).otherwise(F.concat(F.array(p), _grams(p, 2), _grams(p, 3))))
    return F.filter(F.flatten(pieces), lambda t: ~F.array_contains(stop, t) & (strip(t) != ""))


def expand_query(c: Column) -> Column:
    """The question followed by its distinct tokens."""
    more = F.array_join(F.array_distinct(query_tokens(c)), " ")
    return F.when(more == "", c).otherwise(F.concat(c, F.lit(" "), more))


def chunk_header(c: Column) -> Column:
    """Column names of the first header line of a chunk."""
    line = F.regexp_extract(c, r"(?m)^表头: (.*)$", 1)
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")


def chunk_annotation(c: Column) -> Column:
    return F.regexp_extract(c, r"(?m)^业务: (.*)$", 1)


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace; empty without one."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def strip_fence(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"```(?:[a-z]+)?", ""))


def markup_leak(c: Column) -> Column:
    return c.rlike(r'(?i)(?:Column|Row)Span\s*=\s*"?\d+"?')


def nouns_missing(question: Column, html: Column) -> Column:
    """The question quotes nouns and not one of them stands in the table."""
    nouns = F.regexp_extract_all(question, F.lit("[“\"]([^”\"'，。]{2,24})[”\"]"), F.lit(1))
    return (F.size(nouns) > 0) & F.forall(nouns, lambda n: ~F.contains(html, n))


def vertical(question: Column) -> Column:
    return question.rlike("竖排|竖向|竖着")


def precision(question: Column, note: Column) -> Column:
    """Decimal places that the question, or else the format note, asks for; Arabic digits count as well."""
    from .numerals import chinese_int

    pattern = r"保留\s*([一两二三四五六七八九十\d]+)\s*位小数"
    found = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1)
    digits = F.when(found(question) != "", found(question)).otherwise(found(note))
    return chinese_int(digits)


def value_missing(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def json_safe(c: Column) -> Column:
    """A number as JSON can carry it: null for what is none or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
