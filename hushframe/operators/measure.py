"""Column measurements built step by step: pick a column, clean it, size it, aggregate it, add noise.

    Measure(df, max_ids=1).column("x").cast_default("double").clamp(0, 50).resize(1000, 25.0).variance().laplace(5.0)
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.exact import exact_sum
from hushframe.functions.noise import Noise, Secure, Seeded, add_noise, threshold
from hushframe.operators.bounding import keep_smallest
from hushframe.operators.clean import cast_default
from hushframe.operators.domain import clamped, complete
from hushframe.operators.repeat import repeat_rows
from hushframe.plans.accounting import Cost, pure_cost, zcdp_cost
from hushframe.session import written

UNKNOWN = "__unknown__"


@dataclass(frozen=True)
class Measure:
    df: DataFrame
    max_ids: int = 1
    row_key: tuple[str, ...] = ()
    value: str | None = None
    bounds: tuple[float, float] | None = None
    size: int | None = None
    pad: float | None = None
    statistic: str | None = None
    categories: tuple | None = None
    mechanism: str | None = None
    scale: float | None = None
    tau: float | None = None
    seed: int = 0
    tag: str = "measure"

    # -- transformations -------------------------------------------------------------------------------

    def column(self, name: str) -> Measure:
        if name not in self.df.columns:
            raise InvalidQuery(f"unknown column {name!r}")
        return replace(self, value=name, df=self.df.select(*dict.fromkeys([name, *self.row_key])))

    def where(self, predicate) -> Measure:
        return replace(self, df=self.df.filter(predicate))

    def cast_default(self, type_name: str) -> Measure:
        return replace(self, df=self.df.withColumn(self._value(), cast_default(self._value(), type_name)))

    def clamp(self, lower: float, upper: float) -> Measure:
        if lower > upper:
            raise InvalidQuery("lower bound above upper bound")
        column = clamped(self._value(), lower, upper).cast("double")
        return replace(self, df=self.df.withColumn(self._value(), column), bounds=(float(lower), float(upper)))

    def resize(self, size: int, constant: float) -> Measure:
        if self.bounds is None or not self.bounds[0] <= constant <= self.bounds[1]:
            raise InvalidQuery("resize needs a clamp first and a constant inside its bounds")
        if not self.row_key:
            raise InvalidQuery("resize needs row_key columns to choose which rows stay")
        return replace(self, size=int(size), pad=float(constant))

    # -- statistics ------------------------------------------------------------------------------------

    def count(self) -> Measure:
        return replace(self, statistic="count")

    def count_by_categories(self, categories: list) -> Measure:
        return replace(self, statistic="categories", categories=tuple(categories), value=self._value())

    def count_by(self) -> Measure:
        return replace(self, statistic="keys", value=self._value())

    def sum(self) -> Measure:
        if self.bounds is None:
            raise InvalidQuery("a sum needs a clamp first")
        return replace(self, statistic="sum")

    def mean(self) -> Measure:
        return self._sized("mean")

    def variance(self) -> Measure:
        return self._sized("variance")

    def _sized(self, name: str) -> Measure:
        if self.size is None or (name == "variance" and self.size < 2):
            raise InvalidQuery(f"a {name} needs a public size")
        return replace(self, statistic=name)

    # -- measurements ----------------------------------------------------------------------------------

    def laplace(self, scale: float) -> Measure:
        return self._noisy("laplace", scale)

    def gaussian(self, sigma: float) -> Measure:
        return self._noisy("gaussian", sigma)

    def laplace_threshold(self, scale: float, tau: float) -> Measure:
        if self.statistic != "keys":
            raise InvalidQuery("a threshold needs counts by unknown keys")
        return replace(self._noisy("laplace", scale), tau=float(tau))

    def _noisy(self, mechanism: str, scale: float) -> Measure:
        if self.statistic is None:
            raise InvalidQuery("aggregate before adding noise")
        if not scale > 0:
            raise InvalidQuery("noise scale must be positive")
        return replace(self, mechanism=mechanism, scale=float(scale))

    @property
    def sensitivity(self) -> float:
        """L1 (and L2) change when one unit's rows come or go; public size turns that into replacements."""
        if self.statistic in ("count", "categories", "keys"):
            return float(self.max_ids)
        low, high = self.bounds
        if self.statistic == "sum":
            return self.max_ids * max(abs(low), abs(high))
        if self.statistic == "mean":
            return self.max_ids * (high - low) / self.size
        return self.max_ids * (high - low) ** 2 / self.size

    def cost(self, fixed_delta: float | None = None) -> Cost:
        if self.mechanism is None:
            raise InvalidQuery("not a measurement: no noise was added")
        if self.statistic == "keys" and self.tau is None:
            raise InvalidQuery("counts by unknown keys need a threshold")
        if self.mechanism == "gaussian":
            return zcdp_cost(self.sensitivity, self.scale, fixed_delta)
        cost = pure_cost(self.sensitivity, self.scale)
        if self.tau is None:
            return cost
        # a key of one unit alone shows with probability P(its rows + noise >= tau), for each of its keys
        slack = self.tau - self.max_ids
        tail = 0.5 * math.exp(-slack / self.scale) if slack >= 0 else 1.0
        return cost + Cost(0.0, min(1.0, self.max_ids * tail))

    # -- the job ---------------------------------------------------------------------------------------

    def resized(self) -> DataFrame:
        """The column at its public size: hash-random rows when too many, a constant when too few."""
        kept = keep_smallest(self.df, [], self.size, list(self.row_key), self.seed).select(self._value())
        return pad_rows(kept.withColumn(self._value(), F.coalesce(self._value(), F.lit(self.pad))),
                        self._value(), self.size, self.pad)

    def exact(self) -> DataFrame:
        if self.statistic == "count":
            return self.df.agg(F.count("*").alias("value"))
        if self.statistic == "sum":
            return self.df.agg(exact_sum(F.col(self._value()), self.sensitivity).alias("value"))
        if self.statistic == "categories":
            key = F.col(self._value())
            labels = [str(c) for c in self.categories]
            known = F.when(key.isin(*self.categories), key.cast("string")).otherwise(F.lit(UNKNOWN))
            counts = self.df.groupBy(known.alias("category")).agg(F.count("*").alias("value"))
            full = complete(counts, {"category": [*labels, UNKNOWN]}, ["value"])
            positions = F.create_map(*[x for i, c in enumerate([*labels, UNKNOWN]) for x in (F.lit(c), F.lit(i))])
            return full.withColumn("position", positions[F.col("category")]).select("position", "category", "value")
        if self.statistic == "keys":
            return self.df.groupBy(F.col(self._value()).alias("key")).agg(F.count("*").alias("value"))
        return self._moments()

    def _moments(self) -> DataFrame:
        """Mean or variance at the public size, from the sums of the rows that stay plus the padding."""
        low, high = self.bounds
        top = max(abs(low), abs(high))
        kept = keep_smallest(self.df, [], self.size, list(self.row_key), self.seed)
        x = F.coalesce(F.col(self._value()), F.lit(self.pad))
        sums = kept.agg(F.count("*").alias("k"), exact_sum(x, top).alias("s1"), exact_sum(x * x, top * top).alias("s2"))
        n, short = F.lit(float(self.size)), F.lit(float(self.size)) - F.col("k")
        s1 = F.col("s1") + short * F.lit(self.pad)
        s2 = F.col("s2") + short * F.lit(self.pad * self.pad)
        if self.statistic == "mean":
            return sums.select((s1 / n).alias("value"))
        return sums.select(((s2 - s1 * s1 / n) / (n - F.lit(1.0))).alias("value"))

    def noisy(self, mode: Secure | Seeded) -> DataFrame:
        self.cost(fixed_delta=0.5 if self.mechanism == "gaussian" else None)
        keys = {"categories": ["category"], "keys": ["key"]}.get(self.statistic, [])
        out = add_noise(self.exact(), [Noise("value", self.mechanism, self.scale)], keys, mode, self.tag)
        if self.tau is not None:
            out = threshold(out, "value", self.tau)
        return out

    def release(self, mode: Secure | Seeded | None = None, path: str | None = None) -> DataFrame:
        """One draw, written once; the stored rows come back."""
        return written(self.noisy(mode or Secure()), "release", path)

    def _value(self) -> str:
        if self.value is None:
            raise InvalidQuery("pick a column first")
        return self.value


def pad_rows(df: DataFrame, value: str, size: int, constant: Any) -> DataFrame:
    """Append rows holding ``constant`` until the table has ``size`` rows (none when it is long enough).

    The padding is generated on the executors from one counted row, not on the driver.
    """
    short = df.agg((F.lit(size) - F.count("*")).alias("n"))
    filler = repeat_rows(short, "n").select(F.lit(constant).cast(df.schema[value].dataType).alias(value))
    return df.select(value).unionByName(filler)
