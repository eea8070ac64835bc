"""Batch answering: questions and recognised tables in, answers out, in one job.

Every step is set-oriented over all questions. A step that fails leaves an
event or an error in its row; nothing stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import format as A
from ..operators import grid, questions, retrieve, table_ops
from ..scratch import cut
from . import expressions


def candidates(asked: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Every question with the tables of its file; ``tables``: table_id, file_name, table_name, page, html."""
    facts = grid.table_facts(cells)
    second = cells.where("pos = 1").groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("second_row"))
    described = tables.select("table_id", "file_name", "table_name", "page").join(facts, "table_id").join(second, "table_id", "left")
    return asked.join(described, "file_name")


def _one(kind: str, num: Column | None = None, text: Column | None = None, is_int: Column | None = None) -> Column:
    num = F.lit(None).cast("double") if num is None else num
    whole = num == F.floor(num) if is_int is None else is_int
    return F.struct(F.lit(kind).alias("kind"), num.alias("num"), whole.alias("is_int"), (F.lit(None).cast("string") if text is None else text).alias("text")).cast(A.VALUE)


def reply_value(reply: Column, path: str = "$.value") -> Column:
    """A JSON reply's value as struct(value, items): texts, numbers and lists of them."""

    def item(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", _one("text", text=F.try_variant_get(x, "$", "string"))).otherwise(_one("num", F.try_variant_get(x, "$", "double")))

    def made(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        scalar = F.when(kind == "STRING", _one("text", text=F.try_variant_get(v, "$", "string"))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), _one("num", F.try_variant_get(v, "$", "double")))
        items = F.when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), item))
        return F.struct(scalar.alias("value"), items.alias("items"))

    return X.let(F.try_variant_get(F.try_parse_json(reply), path, "variant"), made)


def direct_value(reply: Column, question: Column) -> Column:
    """A model's direct answer as struct(value, items): a number, a JSON list, parts of a compound answer, or its text."""

    def made(s: Column) -> Column:
        bare = F.translate(s, ",", "")
        num = F.when(bare.rlike(X.NUMERIC), bare.try_cast("double"))
        parts = F.transform(A.split_compound(s, question), lambda t: _one("text", text=t))
        items = F.when(num.isNull(), F.coalesce(reply_value(s, "$")["items"], parts))
        return X.let(items, lambda i: F.struct(F.when(num.isNotNull(), _one("num", num, is_int=(num == F.floor(num)) & ~F.contains(s, F.lit(".")))).when(i.isNull() & s.isNotNull(), _one("text", text=s)).alias("value"), i.alias("items")))

    return X.let(X.strip(reply), made)


#: What replies are for: an extraction and its one repetition, a look at the page, the range of a structure
#: question, an operator, two programs, and a direct answer.
PHASES = ["extract", "extract_retry", "vision", "range", "op", "code", "code_retry", "direct"]


def _programs(state: DataFrame, tcells: DataFrame, tcols: DataFrame, phases: list[str]) -> DataFrame:
    """Values of the first program that runs, of each question: question_id, c_value, c_items."""
    attempts = F.array(*(F.struct(F.lit(i).alias("attempt"), F.col(f"r_{p}").alias("program")) for i, p in enumerate(phases)))
    asked = state.where("question_type = 'thinking' AND table_id IS NOT NULL").select("question_id", "table_id", F.explode(attempts).alias("a")).where("a.program IS NOT NULL")
    keyed = asked.select(F.concat_ws("\u0001", "question_id", F.col("a.attempt").cast("string")).alias("question_id"), "table_id", "a.program")
    rows = expressions.run_programs(tcells, tcols, keyed).where("error IS NULL")
    key, attempt = F.split_part("question_id", F.lit("\u0001"), F.lit(1)), F.split_part("question_id", F.lit("\u0001"), F.lit(2)).cast("int")
    each = rows.select(key.alias("question_id"), attempt.alias("attempt"), "place", F.map_values("row").alias("cells"))
    whole = each.groupBy("question_id", "attempt").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cells"))), lambda x: x["cells"]).alias("rows"))  # a program's result
    first = whole.groupBy("question_id").agg(F.min_by("rows", "attempt").alias("rows"))
    flat = F.transform(F.filter(F.transform("rows", lambda r: F.get(r, 0)), lambda t: t.isNotNull()), A.clean_item)
    listed = first.select("question_id", flat.alias("c_items"))
    single = F.size("c_items") == 1
    return listed.where(F.size("c_items") > 0).select("question_id", F.when(single, F.get("c_items", 0)).alias("c_value"), F.when(~single, F.col("c_items")).alias("c_items"))


def answer(asked: DataFrame, tables: DataFrame, replies: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Answers: question_id, answer, score, confidence, events.

    ``asked``: question_id, file_name, question_type, question, table_hint, answer_format, format_note.
    ``replies``: question_id, phase (see PHASES), reply: what models said. Structure
    questions need none, but where no pattern names a range a ``range`` reply can. An extraction without JSON takes its repetition's;
    one that calls for a look at the page takes the ``vision`` reply's. A thinking question takes its operator's result,
    else that of the first program of verbs that runs, else the direct answer. A question whose file has no table is answered empty (event no_table).
    Only the steps that some reply is for are planned.
    """
    asked = asked.select("question_id", "file_name", "question_type", "question", "table_hint", "answer_format", "format_note")
    given = {r[0] for r in replies.select("phase").distinct().collect()}  # eight names at most
    none = F.lit(None)
    # What several branches read is written once; otherwise each branch would carry the whole plan behind it.
    cells = cut(grid.parse_cells(tables), "cells")
    tcols, tcells = (cut(x, "typed") for x in grid.typed(cells))
    said = replies.groupBy("question_id").pivot("phase", PHASES).agg(F.first("reply")).select("question_id", *(F.col(p).alias(f"r_{p}") for p in PHASES))
    ranged = asked.join(said, "question_id", "left").withColumn("range", questions.parse_range(F.col("question")))
    if "range" in given:
        by_model = (F.col("question_type") == "structure") & (F.col("range.how") == "full") & F.col("r_range").isNotNull()
        ranged = ranged.withColumn("range", F.when(by_model, questions.range_from_json(F.col("r_range"))).otherwise(F.col("range")))
    ranged = cut(ranged, "ranged")
    named = ranged.select("question_id", "file_name", "question", "table_hint", F.col("range.page_lo").alias("page_lo"), F.col("range.page_hi").alias("page_hi"))
    chosen = retrieve.select_table(candidates(named, tables, cells), hits).withColumnRenamed("events", "chosen_events")
    state = cut(ranged.join(chosen.select("question_id", "table_id", "chosen_events"), "question_id", "left"), "chosen")

    whole = state.where("question_type = 'structure' AND table_id IS NOT NULL")
    # Each question sees the table through its own range, so the pair is the key of the structure.
    pair = F.concat_ws("\u0001", "question_id", "table_id")
    ranges = whole.select(pair.alias("pair"), "table_id", "range.row_lo", "range.row_hi", "range.col_lo", "range.col_hi")
    seen = cells.join(ranges.select("pair", "table_id"), "table_id").drop("table_id").withColumnRenamed("pair", "table_id")
    structures = grid.structure_json(seen, ranges.select(F.col("pair").alias("table_id"), "row_lo", "row_hi", "col_lo", "col_hi"))
    structures = structures.select(F.split_part("table_id", F.lit("\u0001"), F.lit(1)).alias("question_id"), F.col("json").alias("structure"))
    state = state.join(structures, "question_id", "left")

    kind, has_table = F.col("question_type"), F.col("table_id").isNotNull()
    if given & {"extract", "extract_retry", "vision"}:
        object_ = lambda p: F.nullif(X.json_object(F.col(f"r_{p}")), F.lit(""))
        state = state.withColumn("x", reply_value(F.coalesce(object_("extract"), object_("extract_retry"))))
        looked = F.lit(False)
        if "vision" in given:
            state = state.join(tables.select("table_id", "html"), "table_id", "left")
            shown = F.when(F.col("x.items").isNotNull(), F.array_join(F.transform("x.items", lambda x: x["text"]), "")).otherwise(F.coalesce("x.value.text", F.col("x.value.num").cast("string")))
            looked = (kind == "extract") & has_table & F.col("r_vision").isNotNull() & retrieve.needs_vision(shown, F.col("question"), F.coalesce("html", F.lit("")))
            state = state.withColumn("look", looked).withColumn("x", F.when(F.col("look"), reply_value(object_("vision"))).otherwise(F.col("x"))).drop("html")
            looked = F.col("look")
        state = cut(state.withColumn("x_value", F.col("x.value")).withColumn("x_items", F.col("x.items")).withColumn("looked", F.coalesce(looked, F.lit(False))).drop("x", "look"), "asked")
        texts = F.when(F.col("x_items").isNotNull(), F.transform("x_items", lambda x: x["text"])).otherwise(F.array(F.col("x_value")["text"]))
        checked = retrieve.verify_extract(state.where("question_type = 'extract' AND table_id IS NOT NULL").select("question_id", "table_id", texts.alias("items")), cells)
        state = state.join(checked, "question_id", "left")
    else:
        state = state.select("*", none.cast(A.VALUE).alias("x_value"), none.cast(f"array<{A.VALUE}>").alias("x_items"), F.lit(False).alias("looked"), F.lit(False).alias("verified"))
    if "op" in given:
        ops = table_ops.execute(state.where("question_type = 'thinking' AND table_id IS NOT NULL AND r_op IS NOT NULL").select("question_id", "table_id", F.col("r_op").alias("op_json")), tcols, tcells)
        state = state.join(ops.select("question_id", F.col("value").alias("o_value"), F.col("items").alias("o_items"), F.col("error").alias("o_error")), "question_id", "left")
    else:
        state = state.select("*", none.cast(A.VALUE).alias("o_value"), none.cast(f"array<{A.VALUE}>").alias("o_items"), none.cast("string").alias("o_error"))
    computed = F.coalesce(F.col("o_error").isNull() & (F.col("o_value").isNotNull() | (F.size("o_items") > 0)), F.lit(False))
    coded = F.lit(False)
    if programs := [p for p in ("code", "code_retry") if p in given]:
        state = state.join(_programs(state, tcells, tcols, programs), "question_id", "left")
        coded = ~computed & (F.col("c_value").isNotNull() | F.col("c_items").isNotNull())
        state = state.withColumn("o_value", F.when(coded, F.col("c_value")).otherwise(F.col("o_value"))).withColumn("coded", coded)
        state = state.withColumn("o_items", F.when(F.col("coded"), F.col("c_items")).otherwise(F.col("o_items"))).withColumn("o_error", F.when(~F.col("coded"), F.col("o_error")))
        coded = F.col("coded")
    state = state.withColumn("computed", computed)
    if "direct" in given:
        state = state.withColumn("d", direct_value(F.col("r_direct"), F.col("question"))).withColumn("d_value", F.col("d.value")).withColumn("d_items", F.col("d.items"))
    else:
        state = state.select("*", none.cast(A.VALUE).alias("d_value"), none.cast(f"array<{A.VALUE}>").alias("d_items"))
    # The chain above ends in a table, so that formatting is a plan of its own.
    state = cut(state, "answered")

    computed = F.col("computed")
    length = A.count_if_counting(F.col("o_items"), F.col("answer_format"), F.col("question"))
    counted = _one("num", length.cast("double"))
    structure = _one("text", text=F.col("structure"))
    v = F.when(kind == "structure", F.when(F.col("structure").isNotNull(), structure)).when(kind == "extract", F.col("x_value")).when(computed, F.when(length.isNotNull(), counted).otherwise(F.col("o_value"))).otherwise(F.col("d_value"))
    many = F.when(kind == "structure", none.cast(f"array<{A.VALUE}>")).when(kind == "extract", F.col("x_items")).when(computed, F.when(length.isNull(), F.col("o_items"))).otherwise(F.col("d_items"))
    state = state.withColumn("v", F.when(has_table, v)).withColumn("many", F.when(has_table, many))
    places = F.when(kind == "thinking", X.precision(F.col("question"), F.coalesce("format_note", F.lit(""))))
    text = A.format_answer(F.col("v"), F.col("many"), F.col("answer_format"), F.col("places"), F.col("question"))
    events = F.array(
        F.when(~has_table | F.col("v").isNull() & F.col("many").isNull(), F.lit("no_table")),
        F.when((kind == "structure") & F.col("range.how").isin("full", "fallback_full") & ~F.col("question").rlike("整|全部|完整"), F.lit("range_fallback_full")),
        F.when((kind == "extract") & has_table & ~F.coalesce("verified", F.lit(False)), F.lit("extract_unverified")),
        F.when(F.col("looked"), F.lit("vision_extract")),
        F.when(coded, F.lit("code")),
        F.when((kind == "thinking") & has_table & ~computed, F.lit("sandbox_fail_direct")),
    )
    listed = F.concat(F.coalesce("chosen_events", F.array().cast("array<string>")), F.filter(events, lambda e: e.isNotNull()))
    done = state.withColumn("places", places).select("question_id", text.alias("text"), "answer_format", listed.alias("events")).select("question_id", A.or_empty(F.col("text"), F.col("answer_format")).alias("answer"), "events")
    scored = done.withColumn("score", X.let(F.col("events"), A.confidence_score))
    return scored.select("question_id", "answer", "score", A.confidence(F.col("score")).alias("confidence"), "events")
