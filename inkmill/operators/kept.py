"""Written intermediates: what several parts of a plan read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder of its own only where it is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkmill-"))
        found = context.getCheckpointDir().get()
    return found


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, lost executors cost nothing, columns can still be pruned."""
    path = f"{_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inkmill-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application has kept; frames that read it can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
