"""The corpus pipeline: what is toxic goes, lines are deduplicated, one of each group of near copies stays, leaked benchmark items go, the rest is tokenised.

Each stage takes the documents that its predecessor kept and returns the
columns of documents (the last one a row for each document: its token ids, their
number and hash, in how many chunks it was encoded, and whether decoding gives the text back).
Between stages the documents are written as Parquet and read again.

Edge cases, beyond those of the operators, whose handling of null and empty
texts, very long texts and repeated rows holds in each stage: columns that
documents has beyond its own are carried along, whatever their names, up to
the last stage. n_chars follows the text where lines
were removed from it (null for a null text). A document all of whose lines
went stays, empty, until the near-duplicate stage, which keeps one of them.
Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilex.llm import decontaminate, lines, pieces, simhash, toxicity
from florilex.llm.common import bounded_batches, read, shared_dir, shuffles_released

#: Five-word shingles; candidates have one of 42 words of 24 bits within one bit, and 256 bits within 56 (at a similarity
#: of 0.8 bits differ with a probability of 0.15: 39 of 256 on average, with a deviation of 6; 155 of all 1,024, with one of 11). Exact shingle sets decide.
NEAR = {"size": 5, "words64": 16, "bits": 24, "radius": 1, "most": 56, "check64": 4, "whole": 195, "distinct": True, "similarity": 0.8}


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, *toxicity.train(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    out = lines.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    with shuffles_released(spark):
        return simhash.representatives(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pieces.op_query(docs, keep_ids=True)


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece", tokens)]
#: None of the stages but the second can be said in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
