"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint, shared_dir, shuffles_released, spread, stored

__all__ = ["bounded_batches", "checkpoint", "gathered", "in_steps", "join_counted", "read", "shared_dir", "shuffles_released", "stored", "text_bytes"]

#: Bytes of text that Python code handles at once.
STEP = 1 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes: texts may be long, and a batch is built in memory.

    These are settings of the session, read when a plan runs, so they can't be taken back here; smaller ones stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now is not None and not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; documents that one task would read are dealt out to all cores."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table == "documents" else df


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str = "n", most: int = 1000) -> DataFrame:
    """rows joined with keyed, which has one row for each key and how many rows have it, n.

    The most frequent keys, `most` of them, are broadcast, so their rows stay
    where they are; all other keys are joined by a shuffle. A key of that rest
    has at most one in `most` of all rows. Both tables are read more than once:
    they should be stored or checkpointed.
    """
    heavy = F.broadcast(keyed.orderBy(F.col(n).desc(), *on).limit(most))
    rest = rows.join(heavy.select(*on), on, "left_anti").join(keyed.join(heavy.select(*on), on, "left_anti"), on)
    return rows.join(heavy, on).unionByName(rest)


def text_bytes(name: str = "text"):
    """A text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def in_steps(batches, column: str, size: int = STEP):
    """Arrow batches cut into slices of at most about size bytes (or items) in a column: Python objects take many times that."""
    for b in batches:
        col, at = b.column(column), 0
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset :][: b.num_rows + 1] if b.num_rows else None
        while at < b.num_rows:
            end = min(b.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1))
            yield b.slice(at, end - at)
            at = end


def gathered(batches, column: str, size: int):
    """Arrow batches joined, and cut by `in_steps`, so that each has about size bytes in a column."""
    held: list[pa.RecordBatch] = []
    for part in (x for b in batches for x in in_steps([b], column, size)):
        held.append(part)
        if sum(x.column(column).nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
