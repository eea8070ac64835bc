"""Usage, quality and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# What counts as no answer and as a refusal.
INVALID = ["", "none", "null", "nan"]
REFUSAL = r"数据未提供|数据缺失|无法计算|未提供|无法确定|无法判断"
UNREADABLE = r"\[MASK\]|\[UNSURE|无法读取|数据缺失"
ASKS_NUMBER = r"多少|数值|金额|余额|比例|百分比|增长率|相差|合计|计数|几个|几项"
ASKS_LIST = r"哪些|包括|列出|组成|都有"
ASKS_YES_NO = r"是否|有没有|是不是"
YES_NO = ["是", "否", "Yes", "No", "yes", "no", "TRUE", "FALSE"]


def usage_summary(usage: DataFrame, key: str = "phase") -> DataFrame:
    """Tokens and calls by phase, and a TOTAL row (one aggregation with grouping sets)."""
    rolled = usage.rollup(key).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count("*").alias("calls"), F.grouping(key).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "input_tokens", "output_tokens", "total_tokens", "calls")


def usage_of_questions(usage: DataFrame) -> DataFrame:
    return usage.groupBy("question_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))


def validity(answer: Column) -> Column:
    """invalid (nothing), suspect (a refusal, or JSON with nothing in it), else valid."""
    s = X.strip(F.coalesce(answer, F.lit("")))
    hollow = s.rlike(r'^[\[{]') & (F.length(F.regexp_replace(F.regexp_replace(s, r'"[^"]*"\s*:', ""), r'(?U)[\[\]{},\s"]|null', "")) == 0)
    return F.when(F.lower(s).isin(INVALID), "invalid").when(s.rlike(REFUSAL) | hollow, "suspect").otherwise("valid")


def class_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows by ``key`` and class (column ``class``), with the share of valid ones."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col("class") == c).alias(c) for c in ("valid", "suspect", "invalid")), F.round(F.avg(F.when(F.col("class") == "valid", 1.0).otherwise(0.0)), 4).alias("rate"))


def causes(rows: DataFrame, events_col: str = "events") -> DataFrame:
    """How often each event occurs in ``;``-joined lists."""
    return rows.select(F.explode(F.split(events_col, ";")).alias("e")).select(X.strip(F.col("e")).alias("cause")).where("cause <> ''").groupBy("cause").agg(F.count("*").alias("n"))


def file_rollup(rows: DataFrame) -> DataFrame:
    """By file: n, ok, suspect, invalid, rate and mean score of the valid (see :func:`worst_first`)."""
    kind = F.col("class")
    return rows.groupBy("file_name").agg(
        F.count("*").alias("n"),
        F.count_if(kind == "valid").alias("ok"),
        F.count_if(kind == "suspect").alias("suspect"),
        F.count_if(kind == "invalid").alias("invalid"),
        F.round(F.count_if(kind == "valid") / F.count("*"), 4).alias("rate"),
        F.round(F.avg(F.when(kind == "valid", F.col("score"))), 4).alias("avg_score"),
    )




def worst_first(rollup: DataFrame, n: int | None = None) -> DataFrame:
    """The rollup in report order; ``n`` is the length of the report, not of the data."""
    ordered = rollup.orderBy(F.col("invalid").desc(), F.col("suspect").desc(), "file_name")
    return ordered if n is None else ordered.limit(n)


def degenerate(chunks: DataFrame) -> DataFrame:
    """Files by the number of tables of at most one column and at least four rows."""
    return chunks.groupBy("file_id").agg(F.count_if((F.col("n_cols") <= 1) & (F.col("n_rows") >= 4)).alias("degenerate")).where("degenerate > 0")


def event_files(rows: DataFrame, pattern: str) -> DataFrame:
    """By file, the questions whose events match: file_name, n, ids (sorted, joined)."""
    hit = rows.where(F.col("events").rlike(pattern))
    return hit.groupBy("file_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("question_id")), ",").alias("ids"))


def store_stats(chunks: DataFrame) -> DataFrame:
    """Chunks in all, by file and by engine: scope, name, n."""
    by = lambda scope, c: chunks.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "name", "n")
    whole = chunks.agg(F.count("*").alias("n")).select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("name"), "n")
    return whole.union(by("file", "file_id")).union(by("engine", "source_engine"))


def audit(rows: DataFrame) -> DataFrame:
    """Flags of answers that do not fit their question: question_id, flags, n_flags.

    ``rows``: question_id, question, answer_format, answer, events (``;``-joined), most_rows
    (largest plausible count, 60 where null). Twelve flags in six groups: content, type, number of
    items, range, repetition and format.
    """
    # Named step by step: written out, each flag would repeat all steps below it.
    a, q, f, items, first, num = (F.col(c) for c in ("_a", "question", "answer_format", "_items", "_first", "_num"))
    rows = rows.withColumn("_a", X.strip(F.coalesce("answer", F.lit(""))))
    read = X.let(F.from_json(F.when(a.startswith("[") & a.endswith("]"), a), "array<string>"), lambda r: F.when(F.size(r) > 0, r))
    rows = rows.withColumn("_items", F.coalesce(read, F.array(a))).withColumn("_first", F.get("_items", 0))
    rows = rows.withColumn("_num", X.let(X.strip(F.translate(first, "¥$€", "")), lambda t: F.when(t.rlike(r"^-?[\d,]+\.?\d*%?$"), F.regexp_replace(F.translate(t, ",", ""), "%$", ""))))
    is_num = num.isNotNull()
    rows = rows.withColumn("_value", num.try_cast("double"))
    num = F.col("_value")
    masked = a.rlike(UNREADABLE)
    asked = F.when(q.rlike("[：:]"), F.regexp_count(F.element_at(F.split(q, "："), -1), F.lit("[、，,]")) + 1).otherwise(0)
    echo = F.exists(items, lambda x: (F.length(X.strip(x)) >= 4) & ~F.translate(X.strip(x), ",.-", "").rlike(r"^\d+$") & F.contains(q, X.strip(x)))
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    flags = F.array(
        flag(masked, "unreadable"),
        flag(F.contains(F.coalesce("events", F.lit("")), F.lit("sandbox_fail_direct")), "direct_answer"),
        flag(echo, "echo"),
        flag(q.rlike(ASKS_NUMBER) & ~is_num & ~masked, "number_asked"),
        flag(q.rlike(ASKS_LIST) & (F.size(items) == 1) & is_num, "list_asked"),
        flag(q.rlike(ASKS_YES_NO) & ~first.isin(YES_NO) & ~masked, "yes_or_no_asked"),
        flag((f == "json_array") & a.startswith("[") & (asked >= 2) & (F.size(items) != asked), "item_count"),
        flag(q.rlike("(?i)比例|百分比|percent") & ((num > 100) | (num < 0)), "percent_range"),
        flag(q.rlike(r"几个|几项|多少个|数量") & (num > F.greatest(F.lit(60), F.coalesce("most_rows", F.lit(0)))), "count_over_rows"),
        flag((F.size(items) >= 2) & (F.size(F.array_distinct(items)) == 1) & ~first.isin("", "是", "否"), "all_equal"),
        flag((f == "json_array") & ~a.startswith("["), "list_expected"),
        flag((f == "string") & a.startswith("[") & (F.size(items) > 1), "one_expected"),
    )
    kept = F.filter(flags, lambda x: x.isNotNull())
    return rows.select("question_id", kept.alias("flags"), F.size(kept).alias("n_flags"))


def replay(before: DataFrame, after: DataFrame) -> DataFrame:
    """Answers formatted anew against stored ones: question_id, stored, replayed, changed. Nulls compare equal."""
    b = before.select("question_id", F.col("answer").alias("stored"))
    a = after.select("question_id", F.col("answer").alias("replayed"))
    return b.join(a, "question_id", "left").withColumn("changed", ~F.col("stored").eqNullSafe(F.col("replayed")))


def backfill(answers: DataFrame, fixes: DataFrame) -> DataFrame:
    """Answers with those of ``fixes`` in place, by id."""
    f = fixes.select("question_id", F.col("answer").alias("_fix"))
    return answers.join(f, "question_id", "left").withColumn("answer", F.coalesce("_fix", "answer")).drop("_fix")


def sample(rows: DataFrame, n: int, seed: int = 0, key: str = "question_id") -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key: the same rows whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def question_list(questions: DataFrame, profiles: DataFrame, records: DataFrame, kind: str | None = None, status: str | None = None, needle: str = "") -> DataFrame:
    """Questions with their file's category and their answer, filtered by type, status and a substring."""
    rows = questions.join(profiles.select("file_name", "category"), "file_name", "left").join(records.select("question_id", "answer", "score"), "question_id", "left")
    if kind:
        rows = rows.where(F.col("question_type") == kind)
    answered = F.col("answer").isNotNull()
    tests = {"answered": answered, "unanswered": ~answered, "low": answered & (F.col("score") < 0.5), "repaired": F.size("repaired") > 0}
    if status:
        rows = rows.where(tests[status])
    if needle:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "question_id", "question", "file_name")), F.lower(F.lit(needle))))
    return rows


def route_distribution(pages: DataFrame) -> DataFrame:
    """Files and pages of pages(file_id, category) by category and route, with the file that has most pages (the first of equals)."""
    kind = F.coalesce("category", F.lit("?"))
    by_file = pages.groupBy(kind.alias("category"), "file_id").agg(F.count("*").alias("n"))
    route = F.when(F.col("category").isin("A", "B"), "text").otherwise("vision").alias("route")
    return by_file.groupBy("category", route).agg(F.count("*").alias("files"), F.sum("n").alias("pages"), F.min_by("file_id", F.struct((-F.col("n")).alias("n"), F.col("file_id").alias("f"))).alias("busiest"))


def drilldown(rows: DataFrame, pattern: str) -> DataFrame:
    """Answers worth a look: those that are empty or suspect, or whose events match; ``why`` lists the reasons."""
    kind = validity(F.col("answer"))
    why = F.array(F.when(kind == "invalid", "empty"), F.when(kind == "suspect", "suspect"), F.when(F.coalesce("events", F.lit("")).rlike(pattern), pattern))
    return rows.withColumn("why", F.filter(why, lambda w: w.isNotNull())).where(F.size("why") > 0)


def joined(questions: DataFrame, submission: DataFrame, debug: DataFrame) -> DataFrame:
    """Questions with what a submission and a debug sheet hold for their ids (as texts), null where they hold nothing."""
    keyed = lambda t: t.withColumn("question_id", F.col("id").cast("string")).drop("id")
    extra = keyed(debug).drop("answer")
    return questions.withColumn("question_id", F.col("question_id").cast("string")).join(keyed(submission), "question_id", "left").join(extra, "question_id", "left")


def summary(rows: DataFrame) -> DataFrame:
    """One row over all answers: n, valid, suspect, invalid, rate, mean score of the valid, and files."""
    kind = F.col("class")
    counts = [F.count_if(kind == c).alias(c) for c in ("valid", "suspect", "invalid")]
    return rows.agg(F.count("*").alias("n"), *counts, F.round(F.count_if(kind == "valid") / F.count("*"), 4).alias("rate"), F.round(F.avg(F.when(kind == "valid", F.col("score"))), 4).alias("avg_score"), F.count_distinct("file_name").alias("files"))


def distributions(rows: DataFrame) -> DataFrame:
    """Invalid answers by file and all answers by confidence: scope, name, n."""
    counted = lambda t, scope, c: t.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "name", "n")
    return counted(rows.where("class = 'invalid'"), "file", "file_name").union(counted(rows, "confidence", "confidence"))
