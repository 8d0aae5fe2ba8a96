import zlib

import numpy as np
from pyspark.sql import functions as F

from florilex.llm import shards


def rows(df):
    return sorted((tuple(x) for x in shards.op_query(df).collect()), key=repr)


def test_counts_slots_and_content(spark):
    src = [(i, f"text {i % 7} é" * (i % 11)) for i in range(203)] + [(None, None), (5, "text"), (5, "text"), (900, "")]
    df = spark.createDataFrame(src, "doc_id long, text string").selectExpr("*", "0 as shard", "'x' as slot", "'y' as _fx_other")
    got = rows(df)
    assert sorted(((d, s, c) for d, s, c, *_ in got), key=repr) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in src), key=repr)
    slots = {}
    for _, _, _, law, shard, slot, grown in got:
        assert (law, grown) == ("rows", None)
        slots.setdefault(shard, []).append(slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_many_buckets_and_repeatable(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    one = {(x.doc_id, x.shard, x.slot) for x in shards.shuffled(df, 8, 1, 13).collect()}
    two = {(x.doc_id, x.shard, x.slot) for x in shards.shuffled(df.repartition(7), 8, 1, 13).collect()}
    assert one == two and len(one) == 500
    other = {(x.doc_id, x.shard, x.slot) for x in shards.shuffled(df, 8, 2, 13).collect()}
    assert one != other


def test_empty(spark):
    assert rows(spark.createDataFrame([], "doc_id long, text string")) == []


def test_files_hold_the_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    shards.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.where("shard = 3").count() in (6, 7)


def test_against_plain_shuffle(spark):
    """Every record's place: buckets by seeded hash, each in hash order, then shuffled one swap at a time, laid end to end and dealt out."""
    src = [(i, f"text {i * 7919 % 1000}" * (i % 5)) for i in range(400)]
    df = spark.createDataFrame(src, "doc_id long, text string")
    hashes = {x.doc_id: x.h for x in df.select("doc_id", F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text")).alias("h")).collect()}
    want, at = {}, 0
    for bucket in range(19):
        own = sorted((d for d, h in hashes.items() if h % 19 == bucket), key=hashes.get)
        draw = np.random.Generator(np.random.PCG64([3, bucket])).integers(0, np.arange(len(own), 1, -1)) if len(own) > 1 else []
        for i, j in zip(range(len(own) - 1, 0, -1), draw, strict=True):
            own[i], own[j] = own[j], own[i]
        for d in own:
            want[d] = (at % 5, at // 5)
            at += 1
    assert {x.doc_id: (x.shard, x.slot) for x in shards.shuffled(df, 5, 3, 19).collect()} == want


def test_many_equal_rows_without_number(spark):
    df = spark.createDataFrame([(None, "same")] * 400, "doc_id long, text string").repartition(4)
    out = shards.shuffled(df, 8, 1, 16)
    assert sorted((x.shard, x.slot) for x in out.collect()) == [(s, k) for s in range(8) for k in range(50)]


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 20_000_000), (2, "y"), (3, None)], "doc_id long, text string")
    assert sorted((x.shard, x.slot) for x in shards.shuffled(df, 2).collect()) == [(0, 0), (0, 1), (1, 0)]
