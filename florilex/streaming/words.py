"""Word files as a stream: new files are cut into sentences as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sequence
from ..sources import files


def stream_sentences(spark: SparkSession, path: str, out: str, checkpoint: str, available_now: bool = True, files_at_once: int = 1000):
    """Writes the sentences of word files to Parquet, each file once.

    A file is a document, and arrives whole, so sentences need no state between batches, which have files_at_once files at most.
    """
    arrivals = spark.readStream.format("binaryFile").option("pathGlobFilter", "*_reuses.tsv").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).schema("path string, modificationTime timestamp, length long, content binary").load(path)

    def handle(batch: DataFrame, number: int) -> None:
        paths = [x.path for x in batch.select("path").collect()]
        if paths:
            sequence.sentences(files.word_files(batch.sparkSession, paths)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arrivals.select("path").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
