"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded
hash of document and text. Pass two holds one bucket in memory at a time,
puts it into a canonical order and shuffles it by Fisher-Yates. Buckets laid
end to end are one random order of the corpus; dealing it out in turn gives
shards whose row counts differ by one at most, and gapless slots.

Only texts cross the network once. A task takes a run of neighbouring buckets,
sorted by bucket on disk if need be, one after another; all that it needs to
know of the others is how many rows come before its first. Those counts, one
for each task, of which there are MOST_TASKS at most, come from a first look at
the table. Buckets keep their size however large the table is. Every step is a
function of the rows and the seed, so a lost executor's buckets come out the
same when they are computed again.

Edge cases: a null text has size 1 and the checksum of the empty text. A null
doc_id is hashed like any other value. Rows repeated in full are interchangeable
and get different slots; they share a hash, so a bucket holds all of them, and
grows by what they exceed its size. A very long text makes its bucket as large as it is. An empty table gives an empty result. All columns of the
input are kept, the added ones follow; they replace columns of their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BYTES = 8 << 20
#: Buckets that one task takes, if that doesn't make more tasks than may be.
TASK_BUCKETS, MOST_TASKS = 8, 20_000
#: Rows that are put in order and handed back at once.
BATCH = 500
SEED = 20_240_601


def record_size(text: str = "text"):
    """UTF-8 bytes of the text plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = docs.agg(F.coalesce(F.sum(record_size()), F.lit(0))).first()[0]
    return max(1, -(-total // bucket_bytes))


def fisher_yates(order: list[int], seed: int, bucket: int) -> list[int]:
    """The order shuffled: from the last place on, each is swapped with one drawn from those up to it."""
    n = len(order)
    drawn = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []
    for k, j in enumerate(drawn):
        i = n - 1 - k
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, n_shards: int = 8, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """All columns of docs, shard int and slot long. buckets: as many as make them memory-sized, unless given."""
    docs = docs.drop("shard", "slot")
    buckets = buckets or bucket_count(docs)
    tasks = max(1, min(MOST_TASKS, -(-buckets // TASK_BUCKETS)))
    names = docs.columns
    scattered = docs.withColumn("_fx_hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))).withColumn("_fx_bucket", F.pmod("_fx_hash", F.lit(buckets)))
    scattered = scattered.withColumn("_fx_task", F.expr(f"cast(_fx_bucket * {tasks} div {buckets} as int)"))
    counts = np.zeros(tasks + 1, np.int64)
    for x in scattered.groupBy("_fx_task").count().collect():  # at most MOST_TASKS rows
        counts[x._fx_task + 1] = x["count"]
    before = docs.sparkSession.sparkContext.broadcast(np.cumsum(counts))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(held: list[pa.RecordBatch], first: int):
        t = pa.Table.from_batches(held).combine_chunks()
        n, key = t.num_rows, t.column("_fx_hash").to_numpy()
        order = np.argsort(key, kind="stable").tolist()
        i = 0
        while i < n:  # equal hashes: by the rows themselves
            j = i + 1
            while j < n and key[order[j]] == key[order[i]]:
                j += 1
            if j - i > 1:
                order[i:j] = sorted(order[i:j], key=lambda k: repr(t.slice(k, 1).select(names).to_pylist()))
            i = j
        order = fisher_yates(order, seed, t.column("_fx_bucket")[0].as_py())
        place = first + np.arange(n)
        for k in range(0, n, BATCH):
            out, at = t.take(pa.array(order[k : k + BATCH])).select(names), place[k : k + BATCH]
            out = out.append_column("shard", pa.array((at % n_shards).astype(np.int32))).append_column("slot", pa.array(at // n_shards))
            yield from out.combine_chunks().to_batches()

    def work(batches):
        first, bucket, held = None, None, []
        for b in batches:
            own = b.column("_fx_bucket").to_numpy()
            if first is None and b.num_rows:
                first = int(before.value[b.column("_fx_task")[0].as_py()])
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if len(own) else []
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                if held and own[at] != bucket:
                    yield from shuffle(held, first)
                    first, held = first + sum(x.num_rows for x in held), []
                bucket = own[at]
                held.append(b.slice(at, end - at))
        if held:
            yield from shuffle(held, first)

    rows = scattered.select("_fx_task", "_fx_bucket", "_fx_hash", *names)
    return rows.repartitionById(tasks, F.col("_fx_task")).sortWithinPartitions("_fx_bucket").mapInArrow(work, schema)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = SEED) -> None:
    """Writes the shuffled records as shard=K folders; files in name order have the slots in order."""
    shuffled(docs, n_shards, seed).write.partitionBy("shard").parquet(path)


def op_query(docs: DataFrame) -> DataFrame:
    """The columns of the op5 contract, under the law `rows`."""
    return shuffled(docs.select("doc_id", "text"), 8).select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sizes_query(docs: DataFrame) -> DataFrame:
    """shard, n_rows, first_slot, last_slot, n_slots of the shards of the op5 contract, and n_docs, the rows of all of them: what SQL can tell of a shuffle."""
    own = op_query(docs).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"), F.sum("size").alias("n_bytes"))
    whole = own.agg(F.sum("n_rows").alias("n_docs"), F.sum("n_bytes").alias("all_bytes"))  # of as many rows as there are shards
    return own.drop("n_bytes").crossJoin(F.broadcast(whole))


SIZES_ORACLE = """WITH n AS (SELECT count(*) AS n, coalesce(sum(strlen(coalesce(text, '')) + 1), 0)::BIGINT AS b FROM documents), s AS (SELECT unnest(range(8))::INT AS shard)
 SELECT shard, (n + 7 - shard) // 8 AS n_rows, 0::BIGINT AS first_slot, (n + 7 - shard) // 8 - 1 AS last_slot, (n + 7 - shard) // 8 AS n_slots, n AS n_docs, b AS all_bytes FROM s, n WHERE (n + 7 - shard) // 8 > 0"""
