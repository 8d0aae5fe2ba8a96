"""Sources: annotated documents, word files, verse tables, dictionaries and word lists."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schemas import VERSES, WORD_FILE
from .document_format import opened


#: Bytes and files of a batch that is read at once.
BATCH_BYTES, BATCH_FILES = 8 << 20, 1000


def _listed(path: str, pattern: re.Pattern, recursive: bool) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder, a folder at a time; hidden names don't count, nor do files whose names don't match, or that are empty, as with Spark's own source."""
    store, top = opened(path)
    for x in store.get_file_info(fs.FileSelector(top)):
        if x.base_name.startswith(".") or x.base_name.startswith("_") and "=" not in x.base_name:
            continue
        if x.type == fs.FileType.Directory:
            if recursive:
                yield x.path, True
        elif x.size and pattern.fullmatch(x.base_name):
            yield x.path, False


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that a path names, if it is one of the local file system without wildcards; else None."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
    if not path.startswith("file:") and ("://" in path or not default.startswith("file:")) or re.search(r"[*?\[\]{}\\]", path):
        return None
    top = os.path.abspath(opened(path)[1])
    return top if os.path.isdir(top) else None


def binary_files(spark: SparkSession, path: str, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, content) of all files under a folder whose name matches a pattern (`*` and alternatives in braces).

    Spark's own source keeps an entry for each file on the driver, over a kilobyte. So the folders of
    the local (or a mounted, shared) file system are listed and read by tasks, when the rows are asked
    for, and the driver knows the top only; any other path is left to Spark's source.
    """
    top = _local_folder(spark, path)
    if top is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path).select("path", "content")
    name = re.compile("".join({"*": ".*", "?": ".", "{": "(?:", "}": ")", ",": "|"}.get(c, re.escape(c)) for c in pattern), re.DOTALL)
    kinds = "path string, folder boolean"

    def batch(found: list[tuple[str, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())], ["path", "folder"])

    def listed(batches, deep: bool):
        for b in batches:
            for at, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist(), strict=True):
                left = [(at, folder)]
                while left:
                    at, folder = left.pop()
                    found = list(_listed(at, name, recursive)) if folder else [(at, False)]
                    if deep:
                        left += [x for x in found if x[1]]
                        found = [x for x in found if not x[1]]
                    for k in range(0, len(found), BATCH_FILES):
                        yield batch(found[k : k + BATCH_FILES])

    def contents(batches):
        paths, held, size = [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([f"file:{x}" for x in paths], pa.string()), pa.array(held, pa.binary())], ["path", "content"])

        for b in batches:
            for at in b.column("path").to_pylist():
                with open(at, "rb") as file:
                    held.append(file.read())
                paths.append(at)
                size += len(held[-1])
                if size >= BATCH_BYTES or len(held) >= BATCH_FILES:
                    yield made()
                    paths, held, size = [], [], 0
        if held:
            yield made()

    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the top by one task, the folders in it by many, and then each file by its own path
    first = spark.range(1, numPartitions=1).select(F.lit(top).alias("path"), F.lit(True).alias("folder")).mapInArrow(lambda x: listed(x, False), kinds)
    below = first.repartition(tasks, "path").mapInArrow(lambda x: listed(x, True), kinds) if recursive else first
    return below.select("path").repartition(tasks, "path").mapInArrow(contents, "path string, content binary")


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    return binary_files(spark, path, "*.docx")


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml) of all TEI files, with their extension in either case."""
    return binary_files(spark, path, "*.{xml,XML}").select("path", F.decode("content", "UTF-8").alias("xml"))


def numbered_lines(spark: SparkSession, path: str, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, at, line): the lines of files that are not blank, by their place from 0.

    Spark splits large files by bytes; the numbers are those of a prefix scan: each
    split's lines are counted, and the sums of a file's splits tell where each begins. No file is read whole.
    """
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=recursive, pathGlobFilter=pattern)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r$", "").alias("line")).where("trim(line) <> ''")
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    return lines.join(splits.select("path", "block", "first", before.alias("before")), ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first")).alias("at"), "line")


#: Names of a word file's columns, as its header has them.
HEADER = "\t".join(f.name for f in WORD_FILE.fields)


def _checked_lines(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    """(path, at, line, kind): kind is null, or what is wrong with a line of a word file: 'header', 'long' or 'short'."""
    fields = F.size(F.split(F.regexp_replace("line", r'"([^"]|"")*"', ""), "\t"))
    width = len(WORD_FILE.fields)
    kind = F.when((F.col("at") == 0) & (F.col("line") != HEADER), "header").when(fields > width, "long").when(fields < width, "short")
    return numbered_lines(spark, path, pattern, recursive).withColumn("kind", kind)


def bad_word_files(spark: SparkSession, path: str, pattern: str = "*_reuses.tsv", recursive: bool = True) -> DataFrame:
    """(path, at, kind) of the lines that are not as they should be: another 'header', or too many fields ('long'), for which `word_files` leaves the whole file out; too few ('short'), which it fills up with empty ones."""
    return _checked_lines(spark, path, pattern, recursive).where("kind is not null").select("path", "at", "kind")


def word_files(spark: SparkSession, path: str, pattern: str = "*_reuses.tsv", recursive: bool = True) -> DataFrame:
    """The words of all word files: source_path, source_file, word_index and the columns of the files.

    Words such as 'null' and 'nan' stay words. Quotes are doubled within quoted
    fields, which can't hold line ends. Files are told apart by their path; those that can't be
    read (`bad_word_files` names them) give no words. Blank lines don't count.
    """
    parsed = F.from_csv("line", ", ".join(f"`{f.name}` STRING" for f in WORD_FILE.fields), {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    lines = _checked_lines(spark, path, pattern, recursive)
    bad = lines.where("kind in ('header', 'long')").select("path").distinct()
    rows = lines.where("at > 0").join(bad, "path", "left_anti").withColumn("row", parsed)
    return rows.select(
        F.col("path").alias("source_path"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        (F.col("at") - 1).cast("int").alias("word_index"),
        *[F.coalesce(F.col("row")[f.name], F.lit("")).alias(f.name) for f in WORD_FILE.fields],
    )


def tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = False) -> DataFrame:
    """A table with a header: of a schema, or with types read off the values, or all strings."""
    reader = spark.read.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", str(infer).lower())).csv(path)


def positional(spark: SparkSession, path: str, columns: dict[int, str], width: int) -> DataFrame:
    """Columns of a headed TSV by their position; rows that are too short are dropped."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    rows = spark.read.option("sep", "\t").option("header", "true").option("enforceSchema", "true").option("quote", '"').option("escape", '"').schema(schema).csv(path)
    return rows.where(F.col(f"c{width - 1}").isNotNull()).select(*[F.col(f"c{k}").alias(n) for k, n in columns.items()])


def verses(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, VERSES)


def pairs(spark: SparkSession, path: str, sep: str = ",") -> list[tuple[str, str]]:
    """A small ordered table of two columns without a header, such as rewrites and abbreviations; blanks count."""
    rows = [x.value.split(sep, 1) for x in spark.read.text(path).collect() if x.value.strip()]
    return [(a, b) for a, b in rows]


def word_list(spark: SparkSession, path: str) -> list[str]:
    return [x.value.strip() for x in spark.read.text(path).collect()]


def in_file_order(rows: DataFrame, path: str = "source_path", place: str = "word_index") -> DataFrame:
    """Rows as a walk through the files by name would meet them."""
    return rows.orderBy(path, place)
