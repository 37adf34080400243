"""The release sink: a noisy result is stored once and read from there ever after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.session import written


def write_release(df: DataFrame, path: str | None = None) -> DataFrame:
    """Evaluate the noise exactly once: a second action over the same plan would draw again.

    Fails when ``path`` exists.  A retried task draws again too, but only one attempt is committed.
    """
    return written(df, "release", path)


def read_release(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
