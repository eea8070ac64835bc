"""Benchmark decontamination by winnowing.

Every span of ``window`` words has ``window - gram + 1`` grams of ``gram``
words; its fingerprint is the smallest gram hash among them. A span that a
document shares with a benchmark item has the same grams in both, so the
fingerprints meet: looking for fingerprints loses no shared span. Each meeting
is extended to the whole window, and the join of whole windows with those of the
benchmark confirms it. Items shorter than a window are looked up whole, by their own length.

The corpus is read once, whatever the size of the benchmark. Tasks hold a table of flags
of fixed size, one bit for each value of a fingerprint's leading bits; what
passes it is joined as rows. More benchmark text makes the flags less
selective, never the result less complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..scratch import cut
from . import _carry
from ._words import ALNUM, Words, lists, slices

#: Benchmark text whose windows are broadcast for the join; those of a larger benchmark are shuffled.
BLOCK_BYTES = 8 << 20
#: Leading bits of a fingerprint that the flags tell apart: at least and at most, and flags for each fingerprint in between.
FLAG_BITS, SPARSE = (16, 24), 1024

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def _prints(words: Words, window: int, gram: int) -> np.ndarray:
    """Smallest gram hash of each window."""
    grams = words.grams(gram)
    n = max(0, len(words) - window + 1)
    least = grams[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least


def _item_windows(window: int, gram: int):
    """Windows of items: length, hash of all words, fingerprint and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text")):
                words = Words(part, ALNUM, lower=True)
                ok = words.inside(window)
                found = [(np.full(ok.sum(), window), words.grams(window)[ok], _prints(words, window, gram)[ok], words.doc[: len(ok)][ok])]
                for k in range(1, window):
                    whole = words.whole(k)
                    found.append((np.full(len(whole), k), whole, whole, np.flatnonzero(words.count == k)))
                k, h, p, doc = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h.view(np.int64)), pa.array(p.view(np.int64)), batch.column("item").take(pa.array(doc + at))], ["k", "h", "print", "item"])

    return run


def _flags(windows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of leading bits, and one bit for each of their values that some fingerprint has: two megabytes at most."""
    n = windows.count()
    bits = min(max(int(np.ceil(np.log2(SPARSE * n + 1))), FLAG_BITS[0]), FLAG_BITS[1])
    slot = windows.select(F.shiftrightunsigned("print", 64 - bits).alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
    held = np.zeros(1 << (bits - 6), np.int64)
    for word, value in slot.groupBy("word").agg(F.bit_or("bit")).collect():  # as many rows as the flags have words
        held[word] = value
    return bits, held.view(np.uint8)


def _candidates(window: int, gram: int, lengths: list[int], shared):
    """For each document its number of words, and windows whose fingerprint is flagged; a row's number is fixed when it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, flags = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, part in slices(batch.column("_text")):
                n = len(part)
                words = Words(part, ALNUM, lower=True)
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
                for k in lengths:
                    if len(words) < k:
                        continue
                    full = None if k == window else words.grams(k)
                    look = _prints(words, window, gram) if k == window else full
                    slot = (look >> np.uint64(64 - bits)).astype(np.int64)
                    near = np.flatnonzero(words.inside(k) & ((flags[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
                    if len(near):
                        full = words.grams(k) if full is None else full
                        found.append((near, np.full(len(near), k), full[near]))
                near, k, h = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(near, kind="stable")
                near, k, h = near[order], k[order], h[order]
                doc = words.doc[near]
                struct = pa.StructArray.from_arrays([pa.array(near - words.first[doc], pa.int64()), pa.array(k, pa.int32()), pa.array(h.view(np.int64))], ["start", "k", "h"])
                rows = pa.array(number + np.arange(n), pa.int64())
                number += n
                yield pa.RecordBatch.from_arrays([batch.column(_carry.OWN).slice(at, n), rows, pa.array(words.count, pa.int64()), lists(np.bincount(doc, minlength=n), struct)], [_carry.OWN, "row", "n_words", "near"])

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of hit words, from the windows of each document."""
    for batch in batches:
        n = batch.num_rows
        held = batch.column("windows")
        doc = np.repeat(np.arange(n), np.diff(held.offsets.to_numpy()))
        flat = held.flatten()
        start, k = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        doc, start, stop = _merge(doc, start, start + k)
        spans = lists(np.bincount(doc, minlength=n), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop - start, pa.int64())], ["start", "length"]))
        n_hit = np.bincount(doc, stop - start, n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_hit, pa.int64()), spans], ["row", "n_hit", "hit_spans"])


def _merge(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans: union of overlapping or touching ones of each document."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    shift = doc * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + shift)
    new = np.append(True, (start + shift)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], start[new], (reach - shift)[last]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    gram: int = 4,
    block_bytes: int = BLOCK_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Spans of each document that repeat ``window`` words of a benchmark item.

    One row for each row of ``docs``: the columns ``carry`` (all columns of
    ``docs`` by default), then ``n_words``, ``n_hit`` (words inside any
    occurrence), ``item_ids`` (distinct items with an occurrence, ascending)
    and ``hit_spans`` (maximal runs of hit words). A carried column with one of
    these names raises ValueError; any other name is free.

    Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are
    lower-cased. A null or empty text has no words and no hits; an item
    without words matches nothing; an item with a null id hits words but is
    listed nowhere; items that repeat an id are one item. With an empty benchmark
    every document is clean. Texts of any length are read whole.

    The windows of a benchmark of at most ``block_bytes`` of text are broadcast to the
    join with flagged windows; those of a larger one are shuffled. Documents without a flagged window are not joined.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    ship(spark)
    added = ["n_words", "n_hit", "item_ids", "hit_spans"]
    carry = _carry.chosen(docs, carry, added)
    item = benchmark.schema[item_col]
    items = benchmark.select(_carry.column(item_col).alias("item"), _carry.column(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("print", T.LongType()), T.StructField("item", item.dataType)])
    windows = cut(items.mapInArrow(_item_windows(window, gram), shape).distinct(), "decontaminate-windows")
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # at most ``window`` numbers
    shared = spark.sparkContext.broadcast(_flags(windows))
    rows = docs.select(_carry.own(carry), _carry.column(text_col).alias("_text"))
    near = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("h", T.LongType())]))
    state = T.StructType([_carry.field(docs, carry), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("near", near)])
    read = cut(rows.mapInArrow(_candidates(window, gram, lengths, shared), state), "decontaminate-docs")

    known = windows.groupBy("k", "h").agg(F.collect_set("item").alias("items"))
    known = F.broadcast(known) if total <= block_bytes else known
    hits = read.where(F.size("near") > 0).select("row", F.inline("near")).join(known, ["k", "h"])
    spans = hits.groupBy("row").agg(F.collect_list(F.struct("start", F.col("k").cast("long").alias("k"))).alias("windows"))  # those of one document
    spans = spans.mapInArrow(_spans, T.StructType([T.StructField("row", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", _SPAN)]))
    listed = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    clean = [F.lit(0).cast("long").alias("n_hit"), F.array().cast(T.ArrayType(item.dataType)).alias("item_ids"), F.array().cast(_SPAN).alias("hit_spans")]
    some = read.where(F.size("near") > 0).drop("near").join(spans, "row", "left").join(listed, "row", "left")
    some = some.select(_carry.OWN, "n_words", *(F.coalesce(c, empty).alias(c) for c, empty in zip(added[1:], clean)))
    return _carry.unpacked(read.where(F.size("near") == 0).select(_carry.OWN, "n_words", *clean).union(some), carry, added)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document against every benchmark item, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, benchmark, carry=["doc_id"])
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    n = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, pos, ws[pos] AS w FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM documents WHERE text IS NOT NULL))),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 8) AS k, array_to_string(ws[p : p + least(len(ws), 8) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS p FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, pos, k, CASE WHEN count(*) OVER g = k THEN string_agg(w, ' ') OVER g END AS s
  FROM dw, (SELECT k FROM ks WHERE k = 8)
  WINDOW g AS (PARTITION BY doc_id, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
  UNION ALL
  SELECT a.doc_id, a.pos, ks.k, (SELECT CASE WHEN count(*) = ks.k THEN string_agg(b.w, ' ' ORDER BY b.pos) END FROM dw b WHERE b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + ks.k - 1)
  FROM dw a, ks WHERE ks.k < 8),
hit AS (SELECT dg.doc_id, dg.pos, dg.k, win.item_id FROM dg JOIN win ON dg.s = win.s AND dg.k = win.k),
words AS (SELECT DISTINCT h.doc_id, h.pos + o AS pos FROM (SELECT DISTINCT doc_id, pos, k FROM hit) h, range(0, 8) r(o) WHERE o < h.k),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY 1)
SELECT d.doc_id, coalesce(c.n_words, 0) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
