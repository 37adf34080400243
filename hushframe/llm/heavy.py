"""Heavy hitters by mergeable Misra-Gries summaries, verified by exact counts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a summary.  At most this many keys can hold a share of 1 / COUNTERS of the rows, so a table of
#: verified heavy keys has at most COUNTERS rows whatever the input: that bound is what allows its broadcast.
COUNTERS = 256


def merged(counts: dict, more: dict, counters: int) -> dict:
    """Sum of two summaries, cut back to ``counters`` keys by taking the next largest count off all of them."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) <= counters:
        return counts
    floor = sorted(counts.values(), reverse=True)[counters]
    return {key: n - floor for key, n in counts.items() if n > floor}


def summarise(batches: Iterable[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}
    for batch in batches:
        more: dict[str, int] = {}
        for key, n in zip(*[c.to_pylist() for c in batch.columns]):
            more[key] = more.get(key, 0) + n
        counts = merged(counts, more, counters)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])


def heavy_keys(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Keys that hold at least 1/``counters`` of the rows, with their exact count: at most ``counters`` rows.

    ``key`` is a string column.  Each partition is summarised where it lies; summaries are merged in two levels,
    so no task reads more than about sqrt(partitions) of them.  A summary never misses a key above its share,
    the exact count then drops the others.  Null keys are left out; an empty table has no heavy keys.
    """
    def step(batches):
        yield from summarise(batches, counters)

    rows = df.select(F.col(key).alias("key"), F.lit(1).cast("bigint").alias("n")).filter(F.col("key").isNotNull())
    parts = max(1, math.isqrt(max(1, df.rdd.getNumPartitions())))
    found = rows.mapInArrow(step, "key string, n bigint").repartition(parts).mapInArrow(step, "key string, n bigint")
    found = found.coalesce(1).mapInArrow(step, "key string, n bigint").select("key")
    exact = rows.join(F.broadcast(found), "key").groupBy("key").agg(F.sum("n").alias("n"))
    return exact.filter(F.col("n") * counters >= df.count()).select(F.col("key").alias(key), "n")
