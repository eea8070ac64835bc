"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant: their turns are what a model learns, the others' are
turns of named users, system turns stay system turns. A dialogue is kept as one
row a turn with its offsets in the rendered text, so a conversation of any
length is never gathered into one value. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SYSTEM = "system"
END = "<|end|>\n"
#: Turn numbers of one range; offsets are summed inside ranges, then across their totals.
RANGE = 256


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turn_range: int = RANGE) -> DataFrame:
    """Render every conversation from the perspective of each of its participants.

    One row for each turn and perspective: ``conv_id``, ``perspective`` (the
    speaker shown as the assistant), ``position`` (place of the turn, from 0),
    ``turn``, ``role`` (assistant, user or system), ``name`` (of a user), ``segment`` (rendered text), ``start`` and
    ``stop`` (code points of the segment in the dialogue), ``mask_start`` and
    ``mask_stop`` (what the loss covers: an assistant turn's text and its end mark; else null).

    Participants are the distinct roles but for the system's. A turn with a null
    role is a nameless user's and gives no perspective; a conversation without
    participants gives no rows. A null text is empty. Turns are ordered by number, null numbers
    last, then by role and text; repeated rows are rendered as often as they occur. Rows with
    a null conversation id are one conversation. Other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))
    rows = turns.select(
        key.alias("_key"),
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("speaker"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    who = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM)).select("_key", F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(who, "_key")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.coalesce("speaker", F.lit(""))))
    head = F.concat(F.lit("<|"), F.col("role"), F.when(F.col("name").isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col("name"))), F.lit("|>\n"))
    seen = seen.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("text"), F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    # Turns without a number come last, in order of role and text; their ranges are those of a role and the text's first characters.
    seen = seen.withColumn("_range", F.coalesce(F.floor(F.col("turn") / turn_range), F.lit((1 << 62))))
    part = F.struct(F.col("speaker").isNull().alias("none"), F.coalesce("speaker", F.lit("")).alias("role"), F.substring("text", 1, 3).alias("head"))
    whole = F.struct(F.lit(False).alias("none"), F.lit("").alias("role"), F.lit("").alias("head"))
    seen = seen.withColumn("_part", F.when(F.col("turn").isNull(), part).otherwise(whole))
    group = ["_key", "perspective", "_range", "_part"]
    totals = seen.groupBy(group).agg(F.sum("size").alias("_size"), F.count("*").alias("_count"))
    before = Window.partitionBy("_key", "perspective").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_place"))
    order = Window.partitionBy(group).orderBy(F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_last(), "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = seen.select("*", (F.sum("size").over(upto) - F.col("size")).alias("_at"), (F.row_number().over(order) - 1).alias("_row")).join(base, group)
    start = F.col("_from") + F.col("_at")
    learned = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("_place") + F.col("_row")).alias("position"),
        "turn",
        "role",
        "name",
        "segment",
        start.alias("start"),
        (start + F.col("size")).alias("stop"),
        F.when(learned, start + F.col("head")).alias("mask_start"),
        F.when(learned, start + F.col("size") - 1).alias("mask_stop"),
    )


def dialogues(rendered: DataFrame) -> DataFrame:
    """Whole texts, for conversations that fit a value: ``conv_id``, ``perspective``, ``text`` and ``mask`` (spans learned)."""
    parts = rendered.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("position", "segment", "mask_start", "mask_stop"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_stop"].alias("stop")))
    return parts.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"), spans.alias("mask"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from all perspectives."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP6_SQL = r"""
WITH who AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
s AS (
  SELECT c.conv_id, perspective, turn, c.role AS speaker, coalesce(text, '') AS text,
         CASE WHEN c.role = 'system' THEN 'system' WHEN c.role = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM conversations c JOIN who ON c.conv_id IS NOT DISTINCT FROM who.conv_id),
n AS (SELECT *, CASE WHEN role = 'user' THEN coalesce(speaker, '') END AS name FROM s),
h AS (SELECT *, '<|' || role || CASE WHEN name IS NULL THEN '' ELSE ':' || name END || '|>' || chr(10) AS head FROM n),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS stop FROM g
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS LAST, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, role, name, segment, stop - length(segment) AS start, stop,
       CASE WHEN role = 'assistant' THEN stop - length(segment) + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN stop - 1 END AS mask_stop
FROM o
"""
