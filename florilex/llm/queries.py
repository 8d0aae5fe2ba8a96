"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from . import chat, decontaminate, divergence, lines, media, neighbours, pieces, resample, shards, simhash, suffixes, toxicity, units
from .common import read


def op1_sentencepiece(spark, sf_dir):
    return pieces.op_query(read(spark, sf_dir, "documents"))


def op2_chat_formatting(spark, sf_dir):
    return chat.op_query(read(spark, sf_dir, "conversations"))


def op3_unit_dedup(spark, sf_dir):
    return units.op_query(read(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.op_query(read(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return shards.op_query(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return lines.op_query(read(spark, sf_dir, "documents"))


def op7_media_columns(spark, sf_dir):
    return media.op_query(read(spark, sf_dir, "documents"))


def media_pages(spark, sf_dir):
    return media.links_query(read(spark, sf_dir, "pages"))


def media_references(spark, sf_dir):
    return media.references_query(read(spark, sf_dir, "pages"))


def media_payloads(spark, sf_dir):
    return media.payloads_query(read(spark, sf_dir, "documents"))


def shard_sizes(spark, sf_dir):
    return shards.sizes_query(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return suffixes.op_query(read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.op_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_toxicity(spark, sf_dir):
    return toxicity.op_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_nearest_neighbours(spark, sf_dir):
    return neighbours.op_query(read(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    return divergence.op_query(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark, sf_dir):
    return resample.op_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_chat_formatting, op3_unit_dedup, op4_simhash_near_dedup, op5_sharding, op6_line_dedup, op7_media_columns, media_pages, media_references, media_payloads, shard_sizes, op8_suffix_dedup, op9_benchmark_decontamination, op10_toxicity, op11_nearest_neighbours, op12_source_divergence, op13_importance_resampling)}
ORACLE_SQL = {"op2_chat_formatting": chat.ORACLE, "op6_line_dedup": lines.ORACLE, "media_references": media.REFERENCES_ORACLE, "media_payloads": media.PAYLOADS_ORACLE, "shard_sizes": shards.SIZES_ORACLE, "op11_nearest_neighbours": neighbours.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_importance_resampling": resample.ORACLE}
