"""How close synthetic rows are to another table of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fidelity(a: DataFrame, b: DataFrame, plan: dict) -> DataFrame:
    """Per column: mean and variance on both sides and the total-variation distance of the coded marginals.

    One scan per side counts each column's codes and adds up its numbers; all else is worked out from those few rows.
    """
    left, right = _profile(a, plan, "a"), _profile(b, plan, "b")
    both = left.join(right, ["column", "code"], "full_outer")
    share = F.coalesce(F.col("share_a"), F.lit(0.0)) - F.coalesce(F.col("share_b"), F.lit(0.0))
    stats = [F.max(f"{s}_{side}").alias(f"{s}_{side}") for side in "ab" for s in ("mean", "variance")]
    return both.groupBy("column").agg((F.sum(F.abs(share)) / 2.0).alias("distance"), *stats)


def _profile(df: DataFrame, plan: dict, side: str) -> DataFrame:
    """(column, code, share, mean, variance): a row per code, null codes as -1; the last two are the column's."""
    number = lambda c: F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None).cast("double")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(t.encode(F.col(c)).cast("int"), F.lit(-1)).alias("code"), number(c).alias("x")) for c, t in plan.items()])
    sums = [F.count("*").alias("n"), F.count("x").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v")]
    codes = df.select(F.explode(entries).alias("e")).select("e.*").groupBy("column", "code").agg(*sums)
    whole = Window.partitionBy("column")
    k = F.sum("k").over(whole)
    codes = codes.withColumn("mean", F.sum(F.col("k") * F.col("m")).over(whole) / F.nullif(k, F.lit(0)))
    spread = F.sum(F.col("k") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))).over(whole)
    codes = codes.withColumn("variance", spread / F.nullif(k - 1, F.lit(0))).withColumn("share", F.col("n") / F.sum("n").over(whole))
    return codes.select("column", "code", *[F.col(c).alias(f"{c}_{side}") for c in ("share", "mean", "variance")])
