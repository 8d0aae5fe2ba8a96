"""Sinks. What is written for one document is one file, which the sources read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import ATTACHED_LEFT, ATTACHED_RIGHT
from ..operators import sequence
from ..operators.similarity import numbered
from ..schemas import WORD_FILE
from .document_format import DocumentFiles


def write_tsv(df: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """TSV with a header; by: one folder for each value; order: within files."""
    if by:
        df = df.repartition(*by)
    if order:
        df = df.sortWithinPartitions(*(by or []), *order)
    writer = df.write.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_files(df: DataFrame, path: str, name: str, content: str, mode: str = "append") -> DataFrame:
    """Writes one file for each row, by its name (which may be a relative path), with its text or bytes; (name, size) of each.

    All files appear when the job is done, and none if it fails or two rows share a name; see `document_format`.
    path is a folder that driver and executors share, or the URI of a store that Arrow knows.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DocumentFiles)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    rows.write.format(DocumentFiles.name()).mode(mode).option("job", job).save(path)
    return spark.read.schema("name string, size long").json(f"{path}/_written-{job}")


def file_name(path: str, extension: str, base: str | None = None):
    """A document's file name: its path below a base folder, or the last part of it, with another extension."""
    last = F.element_at(F.split(F.col(path), "/"), -1)
    name = F.when(F.contains(path, F.lit(f"{base}/")), F.substring_index(path, f"{base}/", -1)).otherwise(last) if base else last
    return F.concat(F.regexp_replace(name, r"(_reuses)?\.[^./]*$", ""), F.lit(extension))


def write_xml(files: DataFrame, path: str, base: str | None = None) -> DataFrame:
    """Writes (path, xml) as one .xml file for each document."""
    return write_files(files.select(file_name("path", ".xml", base).alias("name"), "xml"), path, "name", "xml")


def write_word_files(words: DataFrame, path: str, base: str | None = None) -> DataFrame:
    """Writes words as one <document>_reuses.tsv each, which `files.word_files` reads."""
    names = [f.name for f in WORD_FILE.fields]
    line = F.to_csv(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names]), {"sep": "\t", "quote": '"', "escape": '"', "emptyValue": ""})
    rows = words.select("source_path", "word_index", line.alias("row"))
    whole = rows.groupBy("source_path").agg(F.concat(F.lit("\t".join(names) + "\n"), F.array_join(sequence.in_order(F.col("row"), ["word_index"]), "\n"), F.lit("\n")).alias("content"))
    return write_files(whole.select(file_name("source_path", "_reuses.tsv", base).alias("name"), "content"), path, "name", "content")


def write_raw_texts(words: DataFrame, path: str, base: str | None = None) -> DataFrame:
    """Writes the running text of each document's words as one .txt file."""
    whole = sequence.raw_text(words, ["source_path"], "word_index", "word", ATTACHED_LEFT, ATTACHED_RIGHT)
    return write_files(whole.select(file_name("source_path", ".txt", base).alias("name"), "text"), path, "name", "text")


def write_markers(words: DataFrame, marker: str, source: str, path: str, name: str) -> DataFrame:
    """Writes the distinct (marker, source), sorted, as one text file of lines `marker TAB source`."""
    lines = distinct_markers(words, marker, source).select(F.concat_ws("\t", marker, source).alias("line"))
    return write_files(lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content")).withColumn("name", F.lit(name)), path, "name", "content")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """Writes the rows, in order, as one JSON array over the parts of a folder: laid end to end by name they are the array."""
    rows = numbered(df, order, "_fx_number")
    last = rows.count() - 1
    body = F.to_json(F.struct(*df.columns))
    line = F.concat(F.when(F.col("_fx_number") == 0, "[").otherwise(""), body, F.when(F.col("_fx_number") == last, "]").otherwise(","))
    rows.withColumn("value", line).repartitionByRange("_fx_number").sortWithinPartitions("_fx_number").select("value").write.text(path)


def distinct_markers(words: DataFrame, marker: str, source: str) -> DataFrame:
    """Distinct (marker, source), sorted."""
    return words.select(marker, source).where(F.coalesce(F.col(marker), F.lit("")) != "").dropDuplicates().orderBy(marker, source)
