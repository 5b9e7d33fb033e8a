"""A file table kept up to date: Structured Streaming over arriving file records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.manifest import manifest


def read_records(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of file records from parquet files that arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def manifest_stream(records: DataFrame, delay: str = "30 days", time: str = "loaded_at") -> DataFrame:
    """The manifest of each record as it arrives; a redelivery of (repo, path, scanned_at) within ``delay`` is dropped.

    Keys are only kept while the watermark lets a redelivery arrive, so state is bounded.
    """
    return manifest(records.withWatermark(time, delay).dropDuplicatesWithinWatermark(["repo", "path", "scanned_at"]))


def counts_by_day(records: DataFrame, delay: str = "30 days", time: str = "loaded_at") -> DataFrame:
    """Files and bytes per day and bucket; a day is final once the watermark has passed it."""
    return (
        records.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), "bucket")
        .agg(F.count("*").alias("n_files"), F.sum("bytes").alias("total_bytes"))
    )
