"""Chunks of files as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import chunk_files

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_chunks(spark: SparkSession, folder: str, mode: str = "default", glob: str = "*", max_files: int | None = None, **options) -> DataFrame:
    """A stream of the chunks of every file that comes to folder; each file's are those of the batch operator."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return chunk_files(reader.load(folder), mode, **options)


def write_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now as Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
