"""Features over a stream of queries: the batch expressions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.features import with_features
from sparkloom.operators.etl import with_labels
from sparkloom.sources.query_log import SCHEMA


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of log rows."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def feature_stream(log: DataFrame) -> DataFrame:
    """The stream with the base features; stateless, so no watermark is needed."""
    return with_features(log)


def heavy_rate_stream(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Queries and heavy queries of each window; rows later than the watermark are left out."""
    labelled = with_labels(log).withWatermark("createTime", late)
    return labelled.groupBy(F.window("createTime", window)).agg(
        F.count(F.lit(1)).alias("total"), F.sum("is_heavy").cast("bigint").alias("heavy")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total", "heavy")
