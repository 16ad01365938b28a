"""Source records and logs as Parquet, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..model import SCHEDULE_LOG, SOURCE


def read(spark: SparkSession, path: str, schema: T.StructType = SOURCE) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream(spark: SparkSession, path: str, schema: T.StructType = SOURCE, most_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, SCHEDULE_LOG)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch's rows to a folder of its own, whole or not at all: a batch that runs again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
