"""Rows repeated a counted number of times, without one long array in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 100_000


def repeat_rows(df: DataFrame, times: str, block: int = BLOCK) -> DataFrame:
    """Each row ``times`` times (none for counts below 1), with the copy number in ``__copy``.

    A large count is cut into blocks that are shuffled apart before they are unrolled.
    """
    n = F.col(times).cast("bigint")
    starts = df.filter(n > 0).withColumn("__start", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(block).cast("bigint"))))
    spread = starts.repartition(*df.columns, "__start")
    copies = F.sequence(F.col("__start"), F.least(F.col("__start") + block, n) - 1)
    return spread.withColumn("__copy", F.explode(copies)).drop("__start")
