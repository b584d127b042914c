"""Normalising free-text records as they arrive.

Resolution is global, so it stays a batch over the normalised table; this part
of the work is local to a record and runs as a stream of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import records, text_fields


def text_stream(spark: SparkSession, folder: str, source_type: str = "Notes") -> DataFrame:
    """A stream of records, one per text file that appears in a folder (``seq`` is a hash of its name)."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    some = raw.where(F.col("text").rlike(r"(?U)\S"))
    return records(some, source_type, F.col("file"), F.xxhash64("file"), text_fields(F.col("text"), source_type))


def start(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet folder, exactly once; ends when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
