"""Answer formatting, confidence and compound answers (columns in, columns out).

A value is struct(kind, num, is_int, text); a list answer is an array of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from .grid import json_text

VALUE = "struct<kind:string,num:double,is_int:boolean,text:string>"

# What each event takes from the confidence.
PENALTY = {
    "rag_miss": 0.10,
    "table_select_low": 0.10,
    "range_fallback_full": 0.10,
    "extract_unverified": 0.20,
    "vision_fallback": 0.10,
    "sandbox_fail_direct": 0.20,
    "mask_in_table": 0.10,
    "no_table": 0.40,
}


def number_of(c: Column) -> Column:
    """Best effort at a number in a text: the whole text after cleaning, else the first number in it; null without one."""

    def wrapped(s: Column) -> Column:
        return s.rlike(r"^[(（][\s\S]*[)）]$") & (F.length(s) > 1)

    def found(s: Column) -> Column:
        inner = X.strip(F.when(wrapped(s), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s))
        symbols = F.regexp_replace(inner, r"(?U)[＄$￥¥€£%％~≈约\s]", "")
        plain = X.let(symbols, lambda p: F.when(p.rlike(X.DECIMAL_COMMA), F.translate(p, "，,", "..")).otherwise(X.strip(F.translate(p, ",，", ""))))
        whole = X.let(plain, lambda p: F.when(p.rlike(X.NUMERIC), p.try_cast("double")))
        grouped, bare = F.regexp_extract(c, X.GROUPED, 0), F.regexp_extract(c, X.PLAIN, 0)
        first = F.when(grouped != "", grouped).otherwise(bare)
        part = F.when(first != "", F.translate(first, ",，", "").try_cast("double"))
        return F.when(s != "", X.let(F.coalesce(whole, part), lambda n: F.when(wrapped(s), -n).otherwise(n)))

    return X.let(X.strip(c), found)


def maybe_number(c: Column) -> Column:
    """A text that is wholly a number, as struct(num, is_int); codes with leading zeros stay text (null)."""

    def read(t: Column) -> Column:
        bare = F.translate(t, ",", "")
        value = bare.try_cast("double")
        digits = F.split_part(F.regexp_replace(bare, "^-+", ""), F.lit("."), F.lit(1))
        whole = value == F.floor(value)
        code = whole & (F.length(digits) > 1) & digits.startswith("0")
        return F.when(t.rlike(f"^(?:{X.GROUPED}|{X.PLAIN})$") & ~code, F.struct(value.alias("num"), whole.alias("is_int")))

    text = X.strip(F.translate(c, "，", ","))
    return X.let(X.let(text, lambda t: F.when(t.rlike(X.DECIMAL_COMMA), F.translate(t, ",", ".")).otherwise(t)), read)


def clean_item(c: Column) -> Column:
    """A text as a value: half-width, spaces collapsed, a number where it is wholly one."""

    def made(s: Column) -> Column:
        kind = lambda n: F.when(n.isNotNull(), "num").otherwise("text")
        return X.let(maybe_number(s), lambda n: F.struct(kind(n).alias("kind"), n["num"].alias("num"), n["is_int"].alias("is_int"), F.when(n.isNull(), s).alias("text")).cast(VALUE))

    return X.let(F.regexp_replace(X.strip(X.halfwidth(c)), r"[ \t]+", " "), made)


def clean_value(v: Column) -> Column:
    """Texts are cleaned, numbers stay, null and NaN become an empty text."""
    empty = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("is_int"), F.lit("").alias("text")).cast(VALUE)
    return F.when(v.isNull() | (v["kind"] == "null") | F.isnan(F.coalesce(v["num"], F.lit(0.0))), empty).when(v["kind"] == "text", clean_item(v["text"])).otherwise(v.cast(VALUE))


def plain_number(num: Column, places: Column | None = None) -> Column:
    """Without exponent, grouping and trailing zeros; with a fixed number of decimals where asked."""
    if places is None:
        return X.let(num, X.show)
    pattern = F.when(places > 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), places))).otherwise("0")
    return X.let(num, lambda n: F.when(places.isNotNull(), F.call_function("format_number", n, pattern)).otherwise(X.show(n)))


def as_json(v: Column) -> Column:
    return F.when(v["kind"] == "num", X.show(v["num"])).otherwise(json_text(F.coalesce(v["text"], F.lit(""))))


def compound(question: Column) -> Column:
    """Several things are asked in order, so empty places must stay; an unknown question counts as such."""
    return question.isNull() | question.rlike("|".join([*X.COMPOUND_MARKS, "各"]))


def split_compound(c: Column, question: Column) -> Column:
    """Parts of a text that answers several things at once; null where it must stay whole."""
    s = X.strip(c)
    marked = question.rlike("|".join(X.COMPOUND_MARKS))
    parts = F.filter(F.transform(F.split(s, r"[、，,;；]|\n+"), X.strip), lambda p: p != "")
    prose = F.exists(parts, lambda p: (F.length(p) > 12) & p.rlike("[一-鿿]"))
    return F.when(marked & ~s.rlike(f"^{X.GROUPED}$") & ~F.contains(s, F.lit("。")) & (F.size(parts) >= 2) & ~prose, parts)


def format_number(v: Column, places: Column | None = None) -> Column:
    """A number answer: empty where it is masked or not found, 0 where there is none."""

    def shown(v: Column) -> Column:
        lost = (v["kind"] == "text") & (F.contains(v["text"], F.lit("MASK")) | F.contains(v["text"], F.lit("未找到")))
        num = F.when(v["kind"] == "num", v["num"]).otherwise(number_of(v["text"]))
        return F.when(lost, "").otherwise(F.coalesce(plain_number(num, places), F.lit("0")))

    return X.let(v, shown)


def format_array(items: Column, question: Column) -> Column:
    """A JSON list: cleaned items, numbers bare, nulls as empty texts; blanks go unless the question is compound."""
    solid = lambda clean: F.filter(clean, lambda v: (v["kind"] == "num") | (X.strip(v["text"]) != ""))
    kept = X.let(F.transform(items, clean_value), lambda clean: F.when(compound(question), clean).otherwise(solid(clean)))
    return F.concat(F.lit("["), F.array_join(F.transform(kept, as_json), ", "), F.lit("]"))


def format_string(v: Column, items: Column, question: Column) -> Column:
    """A text answer: a list of one is unwrapped, also one written as JSON; longer lists stay lists."""

    def read(text: Column) -> Column:
        # Items of a list written as JSON; null for any other text.
        written = F.when(text.rlike(r"(?s)^\[.*\]$"), F.from_json(text, "array<string>"))
        as_text = lambda t: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("is_int"), t.alias("text")).cast(VALUE)
        return X.let(F.transform(written, as_text), lambda w: F.when(F.size(w) > 0, w))

    def shown(held: Column) -> Column:
        one = F.when(held.isNull(), v).when(F.size(held) == 1, F.get(held, 0))
        text = X.let(clean_value(one), lambda c: F.when(c["kind"] == "num", X.show(c["num"])).otherwise(c["text"]))
        return F.when(F.size(held) > 1, format_array(held, question)).otherwise(text)

    return X.let(F.when(F.size(items) > 0, items).otherwise(read(F.when(v["kind"] == "text", X.strip(v["text"])))), shown)


def format_answer(v: Column, items: Column, answer_format: Column, places: Column, question: Column) -> Column:
    """The answer as submitted. Nothing at all gives an empty text (see :func:`or_empty`)."""
    both = F.struct(v.cast(VALUE).alias("v"), items.cast(f"array<{VALUE}>").alias("items"))
    return X.let(both, lambda s: _formatted(s["v"], s["items"], answer_format, places, question))


def _formatted(v: Column, items: Column, answer_format: Column, places: Column, question: Column) -> Column:
    nothing = (v.isNull() | (v["kind"] == "null") | F.isnan(F.coalesce(v["num"], F.lit(0.0)))) & items.isNull()
    listed = F.coalesce(items, F.array(v))
    json = F.when(items.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(items, as_json), ", "), F.lit("]"))).when(v["kind"] == "num", X.show(v["num"])).otherwise(v["text"])
    number = F.when(items.isNull(), format_number(v, places)).when(F.size(items) == 1, format_number(F.get(items, 0), places)).otherwise(
        F.coalesce(plain_number(number_of(F.array_join(F.transform(items, as_json), ", ")), places), F.lit("0"))
    )
    return (
        F.when(nothing, "")
        .when(answer_format == "number", number)
        .when(answer_format == "json_array", format_array(listed, question))
        .when(answer_format == "json", json)
        .otherwise(format_string(v, items, question))
    )


def or_empty(answer: Column, answer_format: Column) -> Column:
    """What an unanswered question gets: 0 for numbers, nothing else otherwise."""
    return F.when(X.value_missing(answer), F.when(answer_format == "number", "0").otherwise("")).otherwise(answer)


def confidence_score(events: Column) -> Column:
    """One less the penalties of all events (0.1 for unknown ones), at least 0.2."""
    table = F.create_map(*(x for k, p in PENALTY.items() for x in (F.lit(k), F.lit(round(100 * p)))))
    lost = F.aggregate(F.coalesce(events, F.array().cast("array<string>")), F.lit(0), lambda s, e: s + F.coalesce(F.try_element_at(table, e), F.lit(10)))
    return F.greatest(F.lit(0.2), (100 - lost) / F.lit(100))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def count_if_counting(items: Column, answer_format: Column, question: Column) -> Column:
    """Length of a list that answers a counting question with a number; else null."""
    return F.when(items.isNotNull() & (answer_format == "number") & question.rlike(X.COUNTING), F.size(items))
