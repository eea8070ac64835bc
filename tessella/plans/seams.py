"""What needs a model stays pluggable: recognition, chat and embeddings.

Offline, replies are tables that were recorded before; online, a function is
called in each task over Arrow batches, with retries. The number of
partitions bounds how many calls run at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shipping import ship

# What marks an error as worth another try.
RETRYABLE = ["timeout", "timed out", "429", "500", "502", "503", "504", "connection"]


def retryable(message: str) -> bool:
    return any(x in message.lower() for x in RETRYABLE)


class Reply(NamedTuple):
    """What a model said and the tokens it counted."""

    text: str
    input_tokens: int = 0
    output_tokens: int = 0


def call_model(prompts: DataFrame, chat: Callable[[str], str | Reply], *, at_once: int = 8, retries: int = 5, wait: float = 4.0) -> DataFrame:
    """Replies to prompts(question_id, phase, prompt): question_id, phase, reply, error, input_tokens, output_tokens.

    A failed call is a row, not an exception. Tokens are those of a :class:`Reply`, else null.
    """
    ship(prompts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies, errors, tokens = [], [], []
            for prompt in b.column("prompt").to_pylist():
                reply = error = None
                for attempt in range(retries):
                    try:
                        reply, error = chat(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises
                        error = str(e) or type(e).__name__
                        if not retryable(error) or attempt + 1 == retries:
                            break
                        time.sleep(min(60.0, wait * 2**attempt))
                counted = isinstance(reply, tuple)
                replies.append(reply[0] if counted else reply)
                tokens.append(reply[1:3] if counted else (None, None))
                errors.append(error)
            counts = [pa.array([t[i] for t in tokens], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([b.column("question_id"), b.column("phase"), pa.array(replies, pa.string()), pa.array(errors, pa.string()), *counts], ["question_id", "phase", "reply", "error", "input_tokens", "output_tokens"])

    return prompts.repartition(at_once).mapInArrow(run, "question_id string, phase string, reply string, error string, input_tokens long, output_tokens long")


def usage(calls: DataFrame) -> DataFrame:
    """The usage table of model calls: question_id, phase, input_tokens, output_tokens; failed calls count nothing."""
    return calls.where("reply IS NOT NULL").select("question_id", "phase", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")))


def embed(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], *, text_col: str = "chunk_text", at_once: int = 4, batch: int = 20) -> DataFrame:
    """Adds ``vector``: texts go to a model in lists of at most ``batch``; a list that fails gets null vectors."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, vectors = b.column(text_col).to_pylist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    vectors += encode(part)
                except Exception:  # noqa: BLE001  whatever a client raises
                    vectors += [None] * len(part)
            yield b.append_column("vector", pa.array(vectors, pa.list_(pa.float32())))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(at_once).mapInArrow(run, f"{names}, vector array<float>")


def recorded(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies that a table (question_id, phase, reply) holds for the prompts; null where it has none."""
    return prompts.select("question_id", "phase").join(replies.select("question_id", "phase", "reply"), ["question_id", "phase"], "left").withColumn("error", F.when(F.col("reply").isNull(), "no recorded reply"))


def recognise(pages: DataFrame, see: Callable[[str, str, int], str | None]) -> DataFrame:
    """Text of pages(file_id, path, page) as a recogniser sees it; one more try under another prompt where it sees nothing."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, page in zip(b.column("path").to_pylist(), b.column("page").to_pylist()):
                text = None
                for prompt in ("table_recognition", "semantic_rebuild"):
                    try:
                        text = see(prompt, path, page)
                    except Exception:  # noqa: BLE001
                        text = None
                    if text and "<table" in text.lower():
                        break
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("page"), pa.array(out, pa.string())], ["file_id", "page", "raw"])

    return pages.select("file_id", "path", "page").mapInArrow(run, "file_id string, page int, raw string")


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A vector of token counts by hash, for use without an embedding model."""
    place = F.transform(X.query_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("float"))
