"""Streaming intake: files that arrive in a folder become pages as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans.convert import convert_files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, filename, length, content)."""
    rows = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content", "modificationTime")


def write_pages(stream: DataFrame, out: str, checkpoint: str, options: Options | None = None, once: bool = False) -> StreamingQuery:
    """Converts each micro-batch and writes its pages under out/batch=N, overwriting on replay, so a batch that runs again leaves one copy."""

    def write(batch: DataFrame, number: int) -> None:
        pages = convert_files(batch, options)
        pages.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes per window of modification time and extension; files later than late are not counted any more."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).alias("ext")
    return stream.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), ext).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
