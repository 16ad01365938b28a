"""Kafka sources and sinks. The connector's package must be on the class path; nothing here loads it early."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_source(raw: DataFrame) -> DataFrame:
    """Kafka's columns, with headers, as source records."""
    return raw.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("ts_ms"), F.col("timestampType").alias("timestamp_type"), "key", "value", "headers")


def stream(spark: SparkSession, servers: str, topic: str, most: int = 2000, **options: str) -> DataFrame:
    """The committed records of a topic; lost data fails the query."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("includeHeaders", "true").option("kafka.isolation.level", "read_committed").option("failOnDataLoss", "true").option("maxOffsetsPerTrigger", most)
    return as_source(reader.options(**options).load())


def positional(spark: SparkSession, servers: str, topic: str, bounds: dict[int, tuple[int, int]], **options: str) -> DataFrame:
    """Records of offset ranges [first, end) by partition: the narrow read behind a payload join."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true")
    reader = reader.option("startingOffsets", json.dumps({topic: {str(p): a for p, (a, _) in bounds.items()}})).option("endingOffsets", json.dumps({topic: {str(p): b for p, (_, b) in bounds.items()}}))
    return as_source(reader.options(**options).load())


def write(records: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Relayed records or dead letters. Kafka's sink is at-least-once; see README."""
    out = records.select("key", "value", "headers", F.lit(topic).alias("topic"), F.col("out_partition").alias("partition"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").options(**options).save()
