"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
(its bytes, case and punctuation shares, and how much its words repeat) and
mapped to a hidden vector; a gated attention, tanh(V h) * sigmoid(U h),
gives each passage a weight; the weighted mean of the hidden vectors is scored
by a logistic unit. All weights are learned together from document labels
only, by Adam on the log loss, in numpy with fixed seeds.
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
from ._words import SPACED, Words, slices

PASSAGE = 64
#: Labelled documents that training takes at most; which ones is decided by a hash of their ids.
SAMPLE = 4000
#: Passages that training takes at most over all documents; it takes a document whole or not at all.
PASSAGES = 256_000
HIDDEN, GATE, EPOCHS, RATE, DECAY = 24, 16, 60, 0.01, 1e-4
#: Text scored at once.
_SLICE = 1 << 19
EXTRA = 6
FEATURES = 256 + EXTRA


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the place of each text's first; a text without words is one empty passage."""
    words = Words(texts, SPACED)
    n = len(words.count)
    many = np.maximum(1, -(-words.count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    of_word = first[words.doc] + (np.arange(len(words)) - words.first[words.doc]) // PASSAGE
    total = int(first[-1])
    x = np.zeros((total, FEATURES), np.float32)
    x[:, 261] = 1 / PASSAGE  # a passage without words, in whatever company
    if len(words):
        # Bytes from a passage's first word to the next passage's, or to the text's end, belong to it.
        lead = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))
        begin = words.start[lead]
        many_bytes = np.minimum(np.append(begin[1:], len(words.data)), words.at[1:][words.doc[lead]]) - begin
        of_byte = np.repeat(of_word[lead], many_bytes)
        held = words.data[np.repeat(begin - (np.cumsum(many_bytes) - many_bytes), many_bytes) + np.arange(many_bytes.sum())]
        bytes_ = np.bincount(of_byte * 256 + held, minlength=total * 256).reshape(total, 256).astype(np.float32)
        size = np.maximum(1, bytes_.sum(1))
        x[:, :256] = np.sqrt(bytes_ / size[:, None])
        count = np.maximum(1, np.bincount(of_word, minlength=total))
        for key, groups, column in ((of_word, total, 0), (words.doc, n, 3)):
            order = np.lexsort((words.hash, key))
            k, h = key[order], words.hash[order]
            new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
            times = np.diff(np.append(new, len(k)))
            distinct = np.bincount(k[new], minlength=groups)
            most = np.zeros(groups, np.int64)
            np.maximum.at(most, k[new], times)
            size = np.maximum(1, np.bincount(key, minlength=groups))
            spread = slice(None) if column == 0 else np.repeat(np.arange(n), many)
            x[:, 256 + column] = (distinct / size)[spread]
            x[:, 257 + column] = (most / size)[spread]
        x[:, 258] = np.bincount(of_word, words.end - words.start, total) / count / 10
        x[:, 261] = count / PASSAGE
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The fitted model: a few thousand weights."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Attention:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + 0.01)
        x = (x - self.mean) * self.scale
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = [init(x.shape[1], HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN, GATE), init(HIDDEN, GATE), init(GATE, 1)[:, 0], init(HIDDEN, 1)[:, 0], np.float32(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), 64):
                bags = order[at : at + 64]
                size = first[bags + 1] - first[bags]
                rows = np.repeat(first[bags] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                grad = self._gradients(x[rows], np.concatenate([[0], np.cumsum(size)]), y[bags])
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for i, g in enumerate(grad):
                    g = g + DECAY * self.w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = (self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _forward(self, x: np.ndarray, first: np.ndarray):
        w, b, gate_v, gate_u, att, out, bias = self.w
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ gate_v), _sigmoid(h @ gate_u)
        e = (t * s) @ att
        size = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return h, t, s, a, z, _sigmoid(z @ out + bias), size

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, gate_v, gate_u, att, out, bias = self.w
        h, t, s, a, z, p, size = self._forward(x, first)
        d = ((p - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * out, size, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), size))
        dg = de[:, None] * att
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ gate_v.T + ds @ gate_u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, d.sum()]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each bag."""
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self._forward((x - self.mean) * self.scale, first)[5].astype(np.float64) if len(first) > 1 else np.zeros(0)

    def weights(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Attention of each passage; it sums to one in each bag."""
        if self.constant is not None:
            return np.repeat(1 / np.diff(first), np.diff(first))
        return self._forward((x - self.mean) * self.scale, first)[3]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> Attention:
    """Fit on at most ``sample`` labelled documents with all their passages, at most ``passages`` together.

    The sample are the labelled ids of the smallest hashes, so a larger table
    brings no more work. In order of the hashes, ids whose passages no longer fit are left out. Rows of ``labels`` with a null id or label are left out;
    of an id that is labelled twice the smaller label counts. Rows that share an id are bags of their own, and their passages count together. With no or one class of
    labels the model is a constant, the smoothed share of label 1.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    bags = docs.select(_carry.column(id_col).alias("_id"), _carry.column(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text"), _SLICE):
                many = np.maximum(1, -(-Words(texts, SPACED).count // PASSAGE))
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, len(many)).cast(pa.int64()), pa.array(many, pa.int64())], ["_id", "n"])

    sizes = bags.mapInArrow(count, "_id long, n long").groupBy("_id").agg(F.sum("n").alias("n"))
    kept, total = [], 0
    for i, n in sizes.orderBy(F.xxhash64(F.col("_id").cast(docs.schema[id_col].dataType)), "_id").collect():  # a row for each document of the sample
        if total + n <= passages:
            kept, total = [*kept, (i,)], total + n
    bags = bags.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "_id long")), "_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text"), _SLICE):
                x, first = encode(texts)
                held = [x[i:j].astype(np.float16).tobytes() for i, j in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, len(held)).cast(pa.int64()), batch.column("_y").slice(at, len(held)).cast(pa.float64()), pa.array(held, pa.binary())], ["_id", "_y", "x"])

    got = sorted(bags.mapInArrow(run, "_id long, _y double, x binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    y = np.array([r[1] for r in got])
    if len(set(y)) < 2:
        return Attention(constant=float((y.sum() + 1) / (len(y) + 2)))
    parts = [np.frombuffer(r[2], np.float16).reshape(-1, FEATURES) for r in got]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return Attention().fit(np.concatenate(parts).astype(np.float32), first, y)


def score(docs: DataFrame, model: Attention, *, text_col: str = "text", as_col: str = "score", carry: list[str] | None = None) -> DataFrame:
    """Add the chance that each whole text has label 1.

    One row for each row of ``docs`` with the columns ``carry`` (all by default);
    a clash with ``as_col`` raises ValueError. Null and empty texts, and texts
    without words, are a bag of one empty passage and get a score too.
    """
    ship(docs.sparkSession)
    carry = _carry.chosen(docs, carry, [as_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("_text"), _SLICE):
                p = model.score(*encode(texts))
                yield pa.RecordBatch.from_arrays([batch.column(_carry.OWN).slice(at, len(p)), pa.array(p, pa.float64())], [_carry.OWN, "p"])

    got = docs.select(_carry.own(carry), _carry.column(text_col).alias("_text")).mapInArrow(run, T.StructType([_carry.field(docs, carry), T.StructField("p", T.DoubleType())]))
    return _carry.unpacked(got, carry, [F.col("p").alias(as_col)])


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model that saw none of the held-out labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
