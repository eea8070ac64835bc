"""Token counts with the whole-token shortcut.

Offline, each vocabulary string is tried alone: those that the tokenizer's own
library encodes as one token are proved whole. A text is then split into
pre-tokens; a pre-token that is proved whole counts one, and only the rest are
merged by the library (each distinct one once for a task, in a memory of bounded size).
Merges never cross pre-tokens, so the sum is the library's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from . import _carry

#: Distinct merged pre-tokens that a task remembers; beyond it starts afresh.
MEMORY = 400_000


class _Counts(dict):
    """Tokens of a pre-token: 1 for the proved ones, the library's count for others."""

    def __init__(self, whole: list[str], library, memory: int):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.library, self.most = whole, library, memory + len(whole)

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[piece] = n
        return n


def counter(path: str, whole: list[str] | None = None, memory: int = MEMORY):
    """A function from text to its number of tokens; ``path`` ends in .json or .model."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    from ._bpe import load

    bpe = load(path)
    if not bpe.plain:
        return lambda text: len(bpe.library.encode(text, add_special_tokens=False).ids)
    known = _Counts(bpe.whole() if whole is None else whole, bpe.library, memory)

    def count(text: str) -> int:
        if any(s in text for s in bpe.specials):
            return len(bpe.library.encode(text, add_special_tokens=False).ids)
        return sum(map(known.__getitem__, bpe.split.findall(text)))

    return count


def count_tokens(docs: DataFrame, tokenizer: str, *, text_col: str = "text", as_col: str = "n_tokens", carry: list[str] | None = None) -> DataFrame:
    """Add the number of tokens of each whole text as ``as_col``.

    One row for each row of ``docs`` with the columns ``carry`` (all by
    default); a clash with ``as_col`` raises ValueError. A null text counts as
    empty: 0 tokens. No begin, end or padding tokens are added, nothing is cut;
    special strings inside a text are handled as the tokenizer file says.
    ``tokenizer`` is the path of the vocabulary file on every machine.
    """
    spark = docs.sparkSession
    ship(spark)
    carry = _carry.chosen(docs, carry, [as_col])
    proved = None
    if tokenizer.endswith(".json"):
        from ._bpe import load

        bpe = load(tokenizer)
        proved = bpe.whole() if bpe.plain else None
    shared = spark.sparkContext.broadcast(proved)  # as many strings as the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("_text"), "")
            n = pa.array([count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(_carry.OWN), n], [_carry.OWN, "tokens"])

    schema = T.StructType([_carry.field(docs, carry), T.StructField("tokens", T.LongType())])
    got = docs.select(_carry.own(carry), _carry.column(text_col).alias("_text")).mapInArrow(run, schema)
    return _carry.unpacked(got, carry, [F.col("tokens").alias(as_col)])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 50k byte-level BPE."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
