"""Contingency tables for the synthesizers: counted in one scan, only cells that rows fall in, noise on whole public domains."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.noise import Noise, Secure, Seeded, add_noise
from hushframe.ml.groups import plain_uniform
from hushframe.session import small_table, written
from hushframe.synth.prepare import Encoded


def rho_of(epsilon: float, delta: float) -> float:
    """zCDP budget whose conversion gives (epsilon, delta)."""
    log_inverse = math.log(1.0 / delta)
    return (math.sqrt(log_inverse + epsilon) - math.sqrt(log_inverse)) ** 2


def gumbel(mode: Secure | Seeded, *tag) -> float:
    if isinstance(mode, Seeded):
        u = plain_uniform(mode.seed, *tag)
    else:
        u = ((int.from_bytes(os.urandom(8), "big") >> 12) + 0.5) / 2.0**52
    return -math.log(-math.log(u))


def pick(scores: dict, temperature: float, mode: Secure | Seeded, *tag):
    """Exponential mechanism over a few named scores."""
    return max(scores, key=lambda s: (scores[s] / temperature + gumbel(mode, *tag, ",".join(s)), s))


@dataclass(frozen=True)
class Counts:
    """``table``: (marginal, i, j, n), stored; j is -1 for one column.  Cells without rows are absent; private."""

    encoded: Encoded
    table: DataFrame

    def of(self, *sets: tuple[str, ...]) -> DataFrame:
        return self.table.filter(F.col("marginal").isin([",".join(s) for s in sets]))


def counted(encoded: Encoded, sets: list[tuple[str, ...]]) -> Counts:
    """Every row adds one to a cell of each set; partial counts are combined before the shuffle."""
    entry = [F.struct(F.lit(",".join(s)).alias("marginal"), F.col(s[0]).cast("int").alias("i"),
                      (F.col(s[1]) if len(s) > 1 else F.lit(-1)).cast("int").alias("j")) for s in sets]
    cells = encoded.codes.select(F.explode(F.array(*entry)).alias("e")).groupBy("e.marginal", "e.i", "e.j").agg(F.count("*").alias("n"))
    return Counts(encoded, written(cells.select("marginal", "i", "j", "n"), "synth-counts"))


def one_way_cells(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """(marginal, i): every public code of every column."""
    known = small_table(spark, {"marginal": list(sizes), "size": list(sizes.values())}, "marginal string, size int")
    return known.select("marginal", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))


def two_way_cells(codes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(marginal, i, j): every cell of the pairs over (marginal, i), the codes of each column."""
    spark = codes.sparkSession
    named = small_table(spark, {"pair": [",".join(p) for p in pairs], "a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, "pair string, a string, b string")
    second = codes.groupBy("marginal").agg(F.array_sort(F.collect_list("i")).alias("all"))  # the public codes of one column
    rows = named.join(codes.withColumnsRenamed({"marginal": "a"}), "a").join(second.withColumnRenamed("marginal", "b"), "b")
    return rows.select(F.col("pair").alias("marginal"), "i", F.explode("all").alias("j"))


def measured(counts: DataFrame, cells: DataFrame, sigma: float, mode: Secure | Seeded, tag: str) -> DataFrame:
    """(marginal, i, j, n): Gaussian noise on every public cell, those without rows included."""
    found = counts.select(F.col("marginal").alias("__m"), F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("n").alias("__n"))
    same = (F.col("marginal") == F.col("__m")) & (F.col("i") == F.col("__i")) & (F.col("j") == F.col("__j"))
    full = cells.join(found, same, "left").select("marginal", "i", "j", F.coalesce("__n", F.lit(0)).cast("long").alias("n"))
    return add_noise(full, [Noise("n", "gaussian", sigma)], ["marginal", "i", "j"], mode, tag)


def share(n: Column, total: Column, cells: Column) -> Column:
    """Part of the positive counts; equal parts if there are none."""
    return F.when(total > 0, F.greatest(n, F.lit(0.0)) / total).otherwise(F.lit(1.0) / cells)


def distances(counts: DataFrame, modelled: DataFrame, total: float) -> dict[str, float]:
    """Sum of |count - model| over all cells of each marginal, from the cells that rows fall in.

    ``modelled`` has (marginal, i, j, m) for at least those cells; all cells of the model add up to ``total``, so the cells
    without rows add what the others leave.
    """
    found = modelled.select(F.col("marginal").alias("__m"), F.col("i").alias("__i"), F.col("j").alias("__j"), "m")
    same = (F.col("marginal") == F.col("__m")) & (F.col("i") == F.col("__i")) & (F.col("j") == F.col("__j"))
    m = F.coalesce("m", F.lit(0.0))
    rows = counts.join(found, same, "left").groupBy("marginal").agg((F.sum(F.abs(F.col("n") - m)) - F.sum(m)).alias("e")).collect()  # a row per pair
    return {r["marginal"]: r["e"] + total for r in rows}
