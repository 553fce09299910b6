"""Continuous ingest: new files of a folder, batch by batch, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.library import Library


def watch(spark: SparkSession, folder: str, library: Library, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Ingests what appears in ``folder``. The checkpoint remembers the files, the cache key skips known content, so a batch that is run again changes nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            library.ingest_files(batch.select("path", "content"))

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
