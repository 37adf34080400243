"""Request counts, failures and a duration histogram per path and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_metrics(requests: DataFrame, every: str = "1 day", lateness: str = "1 day", time: str = "ts", path: str = "path",
                    duration: str = "duration", failed: Column | None = None, edges: tuple[float, ...] = (10.0, 100.0, 1000.0)) -> DataFrame:
    """The same plan for a batch and a stream: counts per (window, path), with counts of durations up to each edge."""
    broken = F.lit(False) if failed is None else failed
    counts = [F.count("*").alias("n_requests"), F.count_if(broken).alias("n_failed")]
    counts += [F.count_if(F.col(duration) <= e).alias(f"le_{e:g}") for e in edges]
    stamped = requests.withColumn("__at", F.col(time).cast("timestamp"))
    grouped = stamped.withWatermark("__at", lateness).groupBy(F.window("__at", every), F.col(path).alias("path")).agg(*counts)
    return grouped.select(F.col("window.start").alias("window_start"), "path", *[c for c in grouped.columns if c not in ("window", "path")])
