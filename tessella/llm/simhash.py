"""SimHash fingerprints and search within a Hamming radius.

Every term of a text (``gram`` consecutive words, with its number of
occurrences as weight) votes with the bits of its hash: +weight for a set bit,
-weight for a clear one. The signs of the sums are the fingerprint. The share of
differing bits estimates the angle between the term vectors of two texts, so
cos(pi * share) estimates their cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from ..shipping import ship
from . import _carry
from ._words import SPACED, Words, mix, slices

BITS = 128
GRAM = 3
#: Text of one range of ids when documents are put in order.
RANGE_BYTES = 64 << 20
#: Parts in which the fingerprints of one block value are dealt; those they are compared with go to all parts.
SALTS = 4
#: Bits within which the registered query searches, and blocks of its tables.
RADIUS, BLOCKS = 3, 4

#: For each byte, eight lanes of eight bits that hold its bits.
_LANES = np.array([sum(((b >> (7 - j)) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def _terms(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each term; a text of fewer words is one term."""
    ok = words.inside(gram)
    hashes, docs = [words.grams(gram)[ok]], [words.doc[: len(ok)][ok]]
    for k in range(1, gram):
        hashes.append(words.whole(k))
        docs.append(np.flatnonzero(words.count == k))
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def fingerprints(texts: pa.Array, bits: int = BITS, gram: int = GRAM) -> np.ndarray:
    """Fingerprint of each text, as rows of ``bits // 8`` bytes; all zero for a text without words."""
    out = np.zeros((len(texts), bits // 8), np.uint8)
    for at, part in slices(texts):
        h, doc = _terms(Words(part, SPACED), gram)
        n = np.bincount(doc, minlength=len(part))
        full = np.flatnonzero(n)
        if not len(full):
            continue
        first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        pieces = -(-n[full] // 255)  # as many votes as a lane can hold
        place = np.concatenate([[0], np.cumsum(pieces)[:-1]])
        cuts = np.repeat(first - 255 * place, pieces) + 255 * np.arange(pieces.sum())
        for lane in range(bits // 64):
            columns = np.ascontiguousarray(mix(h + np.uint64(0xA0761D6478BD642F * (lane + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8).T)
            for c in range(8):
                sums = np.add.reduceat(_LANES[columns[c]], cuts).view(np.uint8).reshape(-1, 8)
                ones = np.add.reduceat(sums.astype(np.int64), place, axis=0)
                out[at + full, lane * 8 + c] = np.packbits(2 * ones > n[full, None], axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of the term vectors behind two arrays of fingerprints, 0 to 1; equal ones give 1."""
    apart = np.bitwise_count(a ^ b).sum(1)
    return np.maximum(0.0, np.cos(np.pi * apart / (8 * a.shape[1])))


def fingerprint(docs: DataFrame, *, text_col: str = "text", as_col: str = "fingerprint", bits: int = BITS, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """Add the fingerprint of each whole text as a binary column.

    One row for each row of ``docs`` with the columns ``carry`` (all by
    default); a clash with ``as_col`` raises ValueError. A null text counts as
    empty; a text without words has the fingerprint of zeros. Equal texts have
    equal fingerprints. Words are split at ASCII white space and not changed.
    """
    if bits % 64 or bits <= 0:
        raise ValueError("bits must be a multiple of 64")
    ship(docs.sparkSession)
    carry = _carry.chosen(docs, carry, [as_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("_text"), bits, gram)
            yield pa.RecordBatch.from_arrays([batch.column(_carry.OWN), pa.array([p.tobytes() for p in prints], pa.binary())], [_carry.OWN, "print"])

    got = docs.select(_carry.own(carry), _carry.column(text_col).alias("_text")).mapInArrow(run, T.StructType([_carry.field(docs, carry), T.StructField("print", T.BinaryType())]))
    return _carry.unpacked(got, carry, [F.col("print").alias(as_col)])


def _keyed(prints: DataFrame, bits: int, m: int, radius: int) -> DataFrame:
    """A row for each block table and fingerprint: its key, and ``first``, the table's blocks as a mask, and ``upto``, all blocks up to its last."""
    words = [F.conv(F.hex(F.substring("print", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}") for i in range(bits // 64)]
    rows = prints.select("*", *words)
    tables = []
    for some in combinations(range(m), m - radius):
        parts = [x for b in some for x in _block("", b, bits, m)]
        tables.append(F.struct(F.xxhash64(F.lit(len(tables)), *parts).alias("key"), F.lit(sum(1 << b for b in some)).alias("first"), F.lit((2 << some[-1]) - 1).alias("upto")))
    return rows.select("*", F.explode(F.array(*tables)).alias("k")).select(*rows.columns, "k.*")


def _block(prefix: str, b: int, bits: int, m: int) -> list[Column]:
    """The bits of block ``b`` of ``m``, as one number for each word they lie in."""
    low, high = round(b * bits / m), round((b + 1) * bits / m)
    out = []
    for i in range(low // 64, -(-high // 64)):
        a, z = max(low, 64 * i) - 64 * i, min(high, 64 * i + 64) - 64 * i
        out.append(F.shiftrightunsigned(F.shiftleft(F.col(f"{prefix}w{i}"), a), 64 - (z - a)) if z - a < 64 else F.col(f"{prefix}w{i}"))
    return out


def _met(left: DataFrame, right: DataFrame, bits: int, m: int, radius: int) -> DataFrame:
    """Rows of ``left`` and ``right`` (columns print, ...) within the radius, each pair once; columns get an "l_" or "r_" in front.

    Of the tables that bring a pair together, the one of its first agreeing blocks reports it, so
    nothing has to be made distinct. ``right`` is dealt into parts, so a block value of very many fingerprints is split.
    """
    named = lambda t, x: t.select(*(F.col(c).alias(f"{x}_{c}") for c in t.columns))
    salt = F.pmod(F.xxhash64("print", F.lit(1)), F.lit(SALTS))
    there = named(_keyed(right, bits, m, radius).withColumn("salt", salt), "r").drop("r_first", "r_upto")
    here = named(_keyed(left, bits, m, radius).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), "l")
    pairs = here.join(there, (F.col("l_key") == F.col("r_key")) & (F.col("l_salt") == F.col("r_salt")))
    apart = sum((F.bit_count(F.col(f"l_w{i}").bitwiseXOR(F.col(f"r_w{i}"))) for i in range(bits // 64)), F.lit(0))
    agree = F.lit(0)
    for b in range(m):
        same = [x == y for x, y in zip(_block("l_", b, bits, m), _block("r_", b, bits, m))]
        agree = agree + F.when(F.array_min(F.array(*same)) if len(same) > 1 else same[0], 1 << b).otherwise(0)
    return pairs.withColumn("distance", apart).where((F.col("distance") <= radius) & (agree.bitwiseAND(F.col("l_upto")) == F.col("l_first")))


def _check_blocks(bits: int, radius: int, blocks: int | None) -> int:
    m = radius + 2 if blocks is None else blocks
    if m <= radius or m > bits or bits % 64:
        raise ValueError("blocks must be more than radius and at most the bits of a fingerprint, which are a multiple of 64")
    return m


def near_fingerprints(prints: DataFrame, *, id_col: str, print_col: str = "fingerprint", bits: int = BITS, radius: int = 3, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints within ``radius`` bits, and the members of each.

    The bits are cut into ``blocks`` (radius + 2 by default). Two fingerprints
    within the radius agree on at least ``blocks - radius`` whole blocks, so for each
    choice of so many blocks one table, permuted to lead with them, is joined
    on the leading blocks; the rest is compared by counting bits. Nothing is capped. A larger radius
    needs more tables (of ``radius + 1`` blocks, one for each) with shorter keys.

    Returns ``pairs`` (left_print, right_print, distance; left < right) between
    distinct fingerprints and ``members`` (the fingerprint and ``id_col``): equal
    fingerprints are one class and are not paired. Null fingerprints are left out; no rows give no rows.
    """
    m = _check_blocks(bits, radius, blocks)
    members = prints.where(_carry.column(print_col).isNotNull()).select(_carry.column(print_col).alias("print"), _carry.column(id_col).alias(id_col))
    distinct = members.select("print").distinct()
    pairs = _met(distinct, distinct, bits, m, radius).where("l_print < r_print")
    return pairs.select(F.col("l_print").alias("left_print"), F.col("r_print").alias("right_print"), "distance"), members


def count_near(queries: DataFrame, prints: DataFrame, *, print_col: str = "fingerprint", bits: int = BITS, radius: int = RADIUS, blocks: int | None = BLOCKS) -> DataFrame:
    """Search: for each distinct fingerprint of ``queries``, how many rows of ``prints`` have one within ``radius`` bits.

    Columns ``print``, ``rows`` (those with the same fingerprint included) and ``classes`` (distinct fingerprints among
    them). Equal fingerprints are one class that is compared once; answers are counted where they are found,
    before anything is shuffled. A fingerprint that has no row within the radius, or is null, has no row in the result.
    """
    m = _check_blocks(bits, radius, blocks)
    column = _carry.column(print_col)
    classes = prints.where(column.isNotNull()).groupBy(column.alias("print")).agg(F.count("*").alias("n"))
    asked = queries.where(column.isNotNull()).select(column.alias("print")).distinct()
    return _met(asked, classes, bits, m, radius).groupBy(F.col("l_print").alias("print")).agg(F.sum("r_n").alias("rows"), F.count("*").alias("classes"))


def in_order(docs: DataFrame, *, id_col: str, text_col: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (``_own``, ``_text``) dealt by ranges of ``id_col``, one a partition, and sorted in each; each text is shuffled once.

    Null ids come last. Equal ids are ordered by a hash of the text and the text, which also lets a range
    end between them. The ranges are Spark's, from a sample of fixed size of each input partition.
    """
    key = F.coalesce(_carry.column(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(_carry.own([id_col]), _carry.column(text_col).alias("_text"), key.alias("_key"), F.xxhash64(_carry.column(text_col)).alias("_tie"))
    total = int(docs.agg(F.sum(F.octet_length(_carry.column(text_col)))).first()[0] or 0)
    ranges = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // range_bytes))
    return rows.repartitionByRange(ranges, "_key", "_tie").sortWithinPartitions("_key", "_tie", "_text").select(_carry.OWN, "_text")


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, gram: int = GRAM) -> DataFrame:
    """Fingerprint of each text and of an edited copy, with their likeness and that to the next text.

    Columns: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.
    The edited copy has its last quarter (of its code points, rounded down)
    replaced by as many first code points, or all, of the next text by ascending
    ``id_col``; the first text is next to the last. Null texts count as empty. Ids must be integers.
    Null ids come last, equal ids are ordered by a hash of their text. A lone row is its own next. No rows give no rows.

    A task sees one range of ids in order. Its last row needs the first row of the next range, so each task
    writes these two rows' texts, and they are matched by the order of the ranges: one number for each range.
    """
    ship(docs.sparkSession)
    kinds = {"n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType()}
    names = list(kinds)
    _carry.chosen(docs, [id_col], names)
    own = _carry.field(docs, [id_col])
    results = [own, *(T.StructField(c, t) for c, t in kinds.items())]

    def judged(owns: pa.Array, texts: list[str]) -> list[pa.Array]:
        """texts: one more than owns, the next of the last."""
        now, after = texts[:-1], texts[1:]
        size = [len(t) for t in now]
        edited = [t[: n - n // 4] + x[: n // 4] for t, n, x in zip(now, size, after)]
        prints = fingerprints(pa.array(texts, pa.large_string()), bits, gram)
        other = fingerprints(pa.array(edited, pa.large_string()), bits, gram)
        return [
            owns,
            pa.array(size, pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([p.tobytes().hex() for p in prints[:-1]], pa.string()),
            pa.array([p.tobytes().hex() for p in other], pa.string()),
            pa.array(likeness(prints[:-1], other), pa.float64()),
            pa.array(likeness(prints[:-1], prints[1:]), pa.float64()),
        ]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, text = TaskContext.get().partitionId(), None, []

        def out(columns: list[pa.Array], edge: str | None, texts: list[str] | None = None) -> pa.RecordBatch:
            n = len(columns[0])
            missing = [pa.nulls(n, pa.float64() if c.startswith("near") else pa.int64() if c == "n_chars" else pa.string()) for c in names[len(columns) - 1 :]]
            return pa.RecordBatch.from_arrays([*columns, *missing, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts or [None] * n, pa.string())], [_carry.OWN, *names, "part", "edge", "said"])

        for batch in batches:
            for at, piece in slices(batch.column("_text")):
                owns, texts = batch.column(_carry.OWN).slice(at, len(piece)), piece.to_pylist()
                if held is None:
                    yield out([owns.slice(0, 1)], "first", texts[:1])
                else:
                    owns, texts = pa.concat_arrays([held, owns]), text + texts
                if len(owns) > 1:
                    yield out(judged(owns.slice(0, len(owns) - 1), texts), None)
                held, text = owns.slice(len(owns) - 1), texts[-1:]
        if held is not None:
            yield out([held], "last", text)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(judged(batch.column(_carry.OWN).slice(i, 1), [batch.column(c)[i].as_py() for c in ("said", "next")]), [_carry.OWN, *names])

    shape = T.StructType([*results, T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("said", T.StringType())])
    table = cut(in_order(docs, id_col=id_col, text_col=text_col).mapInArrow(inside, shape), "simhash")
    first, last = table.where("edge = 'first'").select("part", F.col("said").alias("next")), table.where("edge = 'last'")
    by_part = Window.orderBy("part")  # a number for each range, no text
    turn = first.select("part", F.lead("part").over(by_part).alias("after"), F.min("part").over(by_part).alias("least")).select("part", F.coalesce("after", "least").alias("after"))
    ends = last.join(turn, "part").select(_carry.OWN, "said", "after").join(first.withColumnRenamed("part", "after"), "after").select(_carry.OWN, "said", "next")
    done = table.where("edge IS NULL").select(_carry.OWN, *names).union(ends.mapInArrow(across, T.StructType(results)))
    return _carry.unpacked(done, [id_col], names)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited copies; for ids divisible by 100, how many documents are within the radius.

    ``n_within`` counts other documents, ``n_classes`` the different fingerprints among them and itself; null for other ids.
    """
    found = edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    prints = found.select(F.unhex("fingerprint").alias("fingerprint"), "doc_id")
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    near = count_near(prints.where(asked), prints).select(F.lower(F.hex("print")).alias("fingerprint"), (F.col("rows") - 1).alias("n_within"), F.col("classes").alias("n_classes"))
    empty = F.lit(None).cast("long")
    return found.where(asked).join(near, "fingerprint", "left").select(*found.columns, "n_within", "n_classes").union(found.where(~asked).select("*", empty.alias("n_within"), empty.alias("n_classes")))
