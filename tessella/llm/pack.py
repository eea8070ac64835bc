"""Packing: concatenate all token streams and cut the result into fixed windows.

First pass: tokenise once, write the tokens with the partition that made them
and their offset inside it. The partitions' totals, summed up in order, give
each partition's global offset. Second pass: every document knows its global
span, so each task cuts its own at multiples of the sequence length and writes
one boundary record for each piece. Only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from ..shipping import ship
from . import _carry
from ._bpe import load

LENGTH = 1024

_TOKENS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType())])
_PIECE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())]
)
#: Bytes of ids in one Arrow batch that a task returns.
BATCH = 8 << 20


def pack(docs: DataFrame, tokenizer: str, *, text_col: str = "text", end_id: int | None = 0, length: int = LENGTH, carry: list[str] | None = None) -> DataFrame:
    """Pack all texts into sequences of ``length`` tokens; one row for each piece.

    Columns: ``carry`` (all columns of ``docs`` but the text by default), then
    ``start`` (tokens of the document before the piece), ``length``,
    ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset`` (place in the
    sequence; both without gaps from 0), and ``ids`` (the piece's ids, unsigned
    32-bit little-endian). A carried column with one of these names raises ValueError; any other name is free.

    A null text counts as empty. Each text is followed by ``end_id`` (None for
    none; a text without tokens then has no piece). Repeated rows are packed as often as they
    occur. Sequences are full but for the last, so padding is below ``length``
    tokens in all. No rows give no pieces. The order of the documents is that of
    the input's partitions; it is fixed when the first pass is written.
    """
    spark = docs.sparkSession
    ship(spark)
    carry = _carry.chosen(docs, carry, _PIECE.names, (text_col,))
    kept = [_carry.field(docs, carry)]
    kind = np.uint16 if max(load(tokenizer).size - 1, end_id or 0) < 1 << 16 else np.uint32

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        tail = np.array([] if end_id is None else [end_id], kind)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                ids, size, first = [], 0, done
                for text in pc.fill_null(batch.column("_text").slice(done), ""):
                    ids.append(np.append(bpe.ids(text.as_py()).astype(kind), tail))
                    done += 1
                    size += ids[-1].nbytes
                    if size >= BATCH:
                        break
                n = np.array([len(x) for x in ids], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(_carry.OWN).slice(first, len(ids)),
                        pa.array(np.full(len(ids), part), pa.int32()),
                        pa.array(local, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    [_carry.OWN, *_TOKENS.names],
                )

    tokens = cut(docs.select(_carry.own(carry), _carry.column(text_col).alias("_text")).mapInArrow(tokenise, T.StructType([*kept, *_TOKENS.fields])), "pack")
    totals = {r[0]: int(r[1]) for r in tokens.groupBy("part").agg(F.sum("n")).collect()}  # a number for each partition
    offsets = np.zeros(max(totals, default=0) + 1, np.int64)
    for part in totals:
        offsets[part] = totals[part]
    shared = spark.sparkContext.broadcast(np.cumsum(offsets) - offsets)

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            begin = base[batch.column("part").to_numpy()] + batch.column("local").to_numpy()
            row, piece, size = [], [], 0
            for i, raw in enumerate(batch.column("tokens")):
                ids = np.frombuffer(raw.as_py(), kind).astype("<u4")
                g = int(begin[i])
                edges = [0, *range(length - g % length, len(ids), length), len(ids)]
                for a, b in zip(edges, edges[1:]):
                    if b > a:
                        row.append(i)
                        piece.append((a, b - a, len(ids), (g + a) // length, (g + a) % length, ids[a:b].tobytes()))
                size += ids.nbytes
                if size >= BATCH:
                    yield out(batch, row, piece)
                    row, piece, size = [], [], 0
            if row:
                yield out(batch, row, piece)

    def out(batch: pa.RecordBatch, row: list[int], piece: list[tuple]) -> pa.RecordBatch:
        own = batch.column(_carry.OWN).take(pa.array(row))
        columns = [pa.array(c, pa.int64()) for c in list(zip(*piece))[:5]] + [pa.array([p[5] for p in piece], pa.binary())]
        return pa.RecordBatch.from_arrays([own, *columns], [_carry.OWN, *_PIECE.names])

    return _carry.unpacked(tokens.mapInArrow(slice_up, T.StructType([*kept, *_PIECE.fields])), carry, _PIECE.names)


def sequences(pieces: DataFrame, *, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Put the pieces together: ``sequence_id``, ``ids`` (binary, padded to ``length``) and ``n_tokens``.

    A sequence has at most ``length`` pieces, so no group is large.
    """
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (length - n).cast("int")))
    return whole.select("sequence_id", F.concat(joined, pad).alias("ids"), n.alias("n_tokens"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with checksums in place of the ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
