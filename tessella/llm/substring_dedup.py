"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is all text of smaller document ids, indexed by the hashes of its
windows of ``window`` words: each hash has the smallest document with that window
and the place where it stands there. Documents are factored greedily: from each
word that starts or continues a match, the factor that reaches furthest is
taken, a factor being a copy of consecutive words of one document. Windows across
factor boundaries are looked up like all others, so a match that straddles two
factors of different sources is seen too. Words in factors are the duplicates.

Look-ups are shuffled rows, combined before they are sent: documents are read in
buckets, and a bucket sends each distinct hash once, however many of its
documents have it. A first round sends winnowed fingerprints (the smallest hash of
the grams of about half a window): a window can occur twice only if its
fingerprint does, so the second round sends only windows with a repeated
fingerprint. Both are answered by one pass over rows sorted by hash, which holds
one row at a time, and a bucket gets back only hashes that some other row shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import _carry
from ._words import SPACED, Words, lists, slices

WINDOW = 13
#: Text of one bucket of documents.
BUCKET_BYTES = 8 << 20
#: Text whose hashes are sorted in one task.
SORT_BYTES = 32 << 20

_FACTORS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "source", "offset")]))


class _Bucket:
    """Documents of one bucket, hashed slice by slice; a row with a null id is neither judged nor a source."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.gram = window, (window + 1) // 2
        ids = table.column("_id").combine_chunks()
        self.judged = np.asarray(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy()
        self.texts = table.column("_text").combine_chunks()

    def windows(self):
        """For each slice: its place, words, and the place and document of each window of a judged document."""
        for at, part in slices(self.texts):
            words = Words(part, SPACED)
            doc = words.doc[: max(0, len(words) - self.window + 1)]
            where = np.flatnonzero(words.inside(self.window) & self.judged[doc + at])
            yield at, words, where, doc[where] + at

    def prints(self, words: Words) -> np.ndarray:
        """Fingerprint of each window."""
        grams = words.grams(self.gram)
        n = max(0, len(words) - self.window + 1)
        least = grams[:n].copy()
        for j in range(1, self.window - self.gram + 1):
            np.minimum(least, grams[j : j + n], out=least)
        return least

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints, and whether two documents here have it."""
        found = []
        for _, words, where, doc in self.windows():
            least = self.prints(words)[where]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
            found.append((least[new], self.ids[doc[new]]))
        h, ids = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        first = _firsts(h)
        return h[first], (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) if len(first) else np.zeros(0, bool)

    def questions(self, shared: np.ndarray) -> list[np.ndarray]:
        """Distinct hashes of windows whose fingerprint is shared, in order of id and place: hash, smallest id, place there, largest id."""
        found = []
        for _, words, where, doc in self.windows():
            at = where[_among(shared, self.prints(words)[where])]
            doc = doc[np.searchsorted(where, at)]
            found.append((words.grams(self.window)[at], self.ids[doc], at - words.first[words.doc[at]]))
        h, ids, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        order = np.lexsort((place, ids, h))
        h, ids, place = h[order], ids[order], place[order]
        first = _firsts(h)
        last = np.append(first[1:], len(h))[: len(first)] - 1
        h, ids, place, most = h[first], ids[first], place[first], ids[last]
        order = np.lexsort((place, ids))  # rows of one document follow one another, so what they share is compressed
        return [x[order] for x in (h, ids, place, most)]


def _firsts(h: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)


def _among(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which values stand in an ordered array."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (h, tag) in order of h, the buckets and hashes of those that are not alone; tag is twice the bucket, plus 1 where it has two."""
    last = None  # hash and tag of the row before, and whether it is sent
    for batch in batches:
        if not batch.num_rows:
            continue
        h, tag = batch.column("h").to_numpy(), batch.column("tag").to_numpy()
        same = h[1:] == h[:-1]
        send = (tag & 1 == 1) | np.append(False, same) | np.append(same, False)
        if last and last[0] == h[0]:
            send[0] = True
            if not last[2]:
                yield _told(np.append(last[0], h[:0]), np.append(last[1], tag[:0]))
        if send.any():
            yield _told(h[send], tag[send])
        last = (h[-1], tag[-1], bool(send[-1]))


def _told(h: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array((tag >> 1).astype(np.int32)), pa.array(h)], ["_bucket", "h"])


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (h, id, place, most, bucket) in order of h, id and place: what a bucket does not know, the first row of its hash, if smaller than ``most``."""
    held = None  # hash, id and place of the first row of the current run
    for batch in batches:
        if not batch.num_rows:
            continue
        h, ids, place, most = (batch.column(c).to_numpy() for c in ("h", "id", "place", "most"))
        first = _firsts(h)
        source, spot = ids[first].copy(), place[first].copy()
        if held and held[0] == h[0]:
            source[0], spot[0] = held[1:]
        held = (h[-1], source[-1], spot[-1])
        size = np.diff(np.append(first, len(h)))
        source, spot = np.repeat(source, size), np.repeat(spot, size)
        send = source < most
        if send.any():
            columns = [batch.column("bucket").filter(pa.array(send)), pa.array(h[send]), pa.array(source[send]), pa.array(spot[send])]
            yield pa.RecordBatch.from_arrays(columns, ["_bucket", "h", "source", "spot"])


def _parse(at: np.ndarray, source: np.ndarray, spot: np.ndarray, doc: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Greedy factors (document, start, length, source, offset there) from matched windows in order."""
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (spot[1:] != spot[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    starts, stops = at[first].tolist(), (at[last] + window).tolist()
    whose, there, owner = source[first].tolist(), spot[first].tolist(), doc[first].tolist()
    out, i, n = [], 0, len(starts)
    reach = 0
    while i < n:
        begin = max(starts[i], reach)
        best = i  # of all matches that hold word ``begin``, the one that reaches furthest
        while i + 1 < n and owner[i + 1] == owner[best] and starts[i + 1] <= begin:
            i += 1
            if stops[i] > stops[best]:
                best = i
        if stops[best] > begin:
            out.append((owner[best], begin, stops[best] - begin, whose[best], there[best] + begin - starts[best]))
        reach = max(reach, stops[best])
        i += 1
    return out


def _cut(words: Words, gone: np.ndarray, layout: str) -> pa.Array:
    """Texts without the words that are gone."""
    n = len(words.count)
    kept = np.flatnonzero(~gone)
    if layout == "words":
        size = words.end[kept] - words.start[kept] + 1
        upto = np.cumsum(size)
        pick = np.repeat(words.start[kept] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
        data = words.data[np.minimum(pick, max(0, len(words.data) - 1))].copy()
        data[upto - 1] = 0x20
        doc = words.doc[kept]
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        data = np.delete(data, upto[last] - 1)
        length = np.bincount(doc, size, n).astype(np.int64)
        length[np.unique(doc)] -= 1
    else:
        follow = np.append(words.start[1:], len(words.data))
        ends = words.at[1:][words.doc]
        stop = np.minimum(follow, ends)
        step = np.zeros(len(words.data) + 1, np.int64)
        np.add.at(step, words.start[gone], 1)
        np.add.at(step, stop[gone], -1)
        keep = np.cumsum(step[:-1]) == 0
        data = words.data[keep]
        before = np.concatenate([[0], np.cumsum(keep)])
        length = np.diff(before[words.at])
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, layout: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Cut every word covered by ``window`` words that also start in a document of smaller id.

    One row for each row of ``docs``: the columns ``carry`` (all but the text by
    default), then ``n_words``, ``n_removed``, ``kept_text`` and ``factors`` (start
    and length in words, the document copied from, and the word where the copy starts there).
    ``layout`` "text" keeps the white space between kept words, "words" puts one
    space. A carried column with one of these names raises ValueError; any other name is free.

    Words are split at ASCII white space and compared unchanged. Windows are
    judged on the input, not on what is left. A null text has no words and an
    empty ``kept_text``. Rows with the same id are one another's equals: neither removes words of
    the other; the offset in such a source is that of one of its rows. A row with a null id is neither judged nor a source. Ids must be
    integers. Texts are read whole, whatever their length; no rows give no rows.
    """
    if window < 2 or layout not in ("text", "words"):
        raise ValueError("window must be 2 at least and layout 'text' or 'words'")
    spark = docs.sparkSession
    ship(spark)
    added = ["n_words", "n_removed", "kept_text", "factors"]
    carry = _carry.chosen(docs, carry, added, (text_col,))
    text = _carry.column(text_col)
    total = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    cores = spark.sparkContext.defaultParallelism
    buckets = max(2 * cores, -(-total // BUCKET_BYTES))
    sorts = max(2 * cores, -(-total // SORT_BYTES))
    # The text is part of the key, so rows that share an id, or have none, don't share a bucket.
    key = F.pmod(F.xxhash64(_carry.column(id_col), text), F.lit(buckets)).cast("int")
    rows = docs.select(key.alias("_bucket"), _carry.column(id_col).cast("long").alias("_id"), text.alias("_text"), _carry.own(carry))

    def ask_fingerprints(k, table):
        h, both = _Bucket(table, window).fingerprints()
        return pa.table({"h": _signed(h), "tag": pa.array(2 * k[0].as_py() + both.astype(np.int64), pa.int64())})

    def ask_windows(k, table, answers):
        h, ids, place, most = _Bucket(table, window).questions(np.sort(_unsigned(answers.column("h"))))
        return pa.table({"h": _signed(h), "place": place, "id": ids, "most": most, "bucket": pa.array(np.full(len(h), k[0].as_py()), pa.int32())})

    def finish(k, table, answers):
        bucket = _Bucket(table, window)
        known = _unsigned(answers.column("h"))
        order = np.argsort(known)
        known, source, spot = known[order], answers.column("source").to_numpy()[order], answers.column("spot").to_numpy()[order]
        out = []
        for at, words, where, doc in bucket.windows():
            n = len(words.count)
            h = words.grams(window)[where] if len(known) else np.zeros(0, np.uint64)
            hit = np.flatnonzero(_among(known, h))
            which = np.searchsorted(known, h[hit])
            smaller = source[which] < bucket.ids[doc[hit]]
            hit, which = hit[smaller], which[smaller]
            factors = _parse(where[hit], source[which], spot[which], doc[hit] - at, window)
            f = np.array(factors, np.int64).reshape(-1, 5)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, f[:, 1], 1)
            np.add.at(step, f[:, 1] + f[:, 2], -1)
            gone = np.cumsum(step[:-1]) > 0
            struct = pa.StructArray.from_arrays([pa.array(f[:, 1] - words.first[f[:, 0]]), *(pa.array(f[:, i]) for i in (2, 3, 4))], ["start", "length", "source", "offset"])
            removed = pa.array(np.bincount(words.doc[gone], minlength=n), pa.int64())
            columns = [table.column(_carry.OWN).slice(at, n).combine_chunks(), pa.array(words.count, pa.int64()), removed, _cut(words, gone, layout).cast(pa.string()), lists(np.bincount(f[:, 0], minlength=n), struct)]
            out.append(pa.table(columns, names=[_carry.OWN, *added]))
        return pa.concat_tables(out)

    # One exchange of the texts serves all three readings; its tasks are as many as the text asks for.
    grouped = rows.repartition(max(sorts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_bucket").groupBy("_bucket")
    prints = grouped.applyInArrow(ask_fingerprints, "h long, tag long").repartition(sorts, "h").sortWithinPartitions("h")
    shared = prints.mapInArrow(_repeated, "_bucket int, h long")
    asked = grouped.cogroup(shared.groupBy("_bucket")).applyInArrow(ask_windows, "h long, place long, id long, most long, bucket int")
    asked = asked.repartition(sorts, "h").sortWithinPartitions("h", "id", "place")
    answers = asked.mapInArrow(_sources, "_bucket int, h long, source long, spot long")
    schema = T.StructType(
        [_carry.field(docs, carry)] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("factors", _FACTORS)]
    )
    return _carry.unpacked(grouped.cogroup(answers.groupBy("_bucket")).applyInArrow(finish, schema), carry, added)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that a smaller document has too, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_substrings(docs, layout="words", carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, pos, ws[pos] AS w FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL))),
win AS (
  SELECT doc_id, pos, sha256(s) AS s FROM (
    SELECT doc_id, pos, CASE WHEN count(*) OVER g = 13 THEN string_agg(w, ' ') OVER g END AS s
    FROM dw WINDOW g AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE s IS NOT NULL),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT win.doc_id, win.pos + o AS pos FROM win JOIN least_doc USING (s), range(0, 13) r(o) WHERE least_doc.m < win.doc_id),
kept AS (
  SELECT dw.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed,
         coalesce(string_agg(dw.w, ' ' ORDER BY dw.pos) FILTER (gone.pos IS NULL), '') AS t
  FROM dw LEFT JOIN gone ON gone.doc_id = dw.doc_id AND gone.pos = dw.pos GROUP BY dw.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
