"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and Spark is local, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="florilex-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled is deleted when that query is done, and not when the driver happens to collect garbage.

    For steps that each end in a checkpoint or a stored table, after which nobody needs the shuffle files.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back. Hashes, which don't compress, need no more than lz4_raw."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt out to all of them before something expensive; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def apart_unless(asks: Column, key: Column, columns: list[str]) -> Column:
    """A join's key for rows that ask for a partner; all others get keys of their own that match nothing, so that they don't meet in one task as null keys do.

    Of a string key: text that begins with a NUL. columns: what tells the rows apart.
    """
    return F.when(asks, key.cast("string")).otherwise(F.concat(F.lit("\0"), F.xxhash64(*columns).cast("string")))


def sampled(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """The n rows, of total ones, whose keys have the least hashes; all but about 2 n are left out where they lie."""
    part = 1 << 40
    most = min(part, -(-2 * n * part // max(total, 1)))
    return df.where(F.pmod(F.xxhash64(key), F.lit(part)) < most).orderBy(F.pmod(F.xxhash64(key), F.lit(part)), key).limit(n)
