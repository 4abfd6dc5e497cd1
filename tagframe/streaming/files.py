"""Directory entries of files as they arrive in a folder.

Parsing needs no state, so the batch operators apply to a stream as they are; only
last_of_each_tag would need an aggregation, and within one directory it can be left
to the reader of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.sources import files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_entries(spark: SparkSession, path: str, pattern: str = "*.tif", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming table of entries: file_id, ifd_index and the entry columns."""
    raw = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
    return files.entries(files.ifds(files.with_header(raw.select(F.col("path").alias("file_id"), "length", "content"))))
