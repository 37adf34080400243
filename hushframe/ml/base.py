"""Shared pieces of private models: noisy sums in one pass, predictions as columns, parameters as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.exact import exact_sum, grid_digits
from hushframe.functions.noise import Noise, Secure, Seeded, add_noise
from hushframe.operators.domain import clamped, complete
from hushframe.plans.accounting import Cost

Bounds = dict[str, tuple[float, float]]


def noisy_sums(df: DataFrame, sums: dict[str, tuple[Column, float]], epsilon: float, mode: Secure | Seeded, tag: str,
               by: dict[str, list] | None = None, counts: tuple[str, ...] = (), max_ids: int = 1) -> DataFrame:
    """Row counts and bounded sums per public group, epsilon shared evenly by all of them.

    One scan and one partial aggregation whatever the number of sums; the result has one row per group.
    """
    share = epsilon / (len(sums) + len(counts))
    columns = [F.count(F.lit(1)).alias(c) for c in counts] + [exact_sum(c, b).alias(n) for n, (c, b) in sums.items()]
    if by:
        table = complete(df.groupBy(*by).agg(*columns), by, [*counts, *sums])
    else:
        table = df.agg(*columns)
    noises = [Noise(c, "laplace", max_ids / share) for c in counts]
    noises += [Noise(n, "laplace", max_ids * b / share) for n, (_, b) in sums.items()]
    return add_noise(table, noises, list(by or {}), mode, tag)


MAX_SUM_COLUMNS = 200


def noisy_products(df: DataFrame, terms: list[Column], pairs: list[tuple[int, int]], prefix: str, epsilon: float, mode: Secure | Seeded,
                   tag: str) -> DataFrame:
    """Noisy sums of products of [-1, 1]-bounded terms, one column ``{prefix}_i_j`` per pair.

    Many pairs would make one aggregation too wide to compile; they are added up per partition instead, on the
    same grid of whole numbers, so that both ways give the same sum whatever the order of rows.
    """
    names = {p: f"{prefix}_{p[0]}_{p[1]}" for p in pairs}
    if len(pairs) <= MAX_SUM_COLUMNS:
        return noisy_sums(df, {names[i, j]: (terms[i] * terms[j], 1.0) for i, j in pairs}, epsilon, mode, tag)
    rows = df.select(*[t.alias(f"t{i}") for i, t in enumerate(terms)])
    sums = partition_sums(rows, rows.columns, lambda x: _grid_products(x, pairs), exact=True)
    scale = 10.0 ** grid_digits(1.0)
    exact = df.sparkSession.createDataFrame([[v / scale for v in (sums or [0] * len(pairs))]], [names[p] for p in pairs])
    return add_noise(exact, [Noise(n, "laplace", len(pairs) / epsilon) for n in names.values()], [], mode, tag)


def _grid_products(x: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """What ``exact_sum`` adds, pair by pair."""
    scale = 10.0 ** grid_digits(1.0)
    return np.array([np.floor(x[:, i] * x[:, j] * scale + 0.5).astype(np.int64).sum() for i, j in pairs])


def unit_scaled(bounds: Bounds) -> dict[str, Column]:
    """Each bounded column moved onto [-1, 1]; missing values sit in the middle."""
    out = {}
    for c, (low, high) in bounds.items():
        middle, half = (low + high) / 2.0, (high - low) / 2.0 or 1.0
        out[c] = F.coalesce((clamped(c, low, high).cast("double") - F.lit(middle)) / F.lit(half), F.lit(0.0))
    return out


def partition_sums(df: DataFrame, columns: list[str], block: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray | list[int]:
    """Sum of ``block(rows)`` over all rows: one vector per partition, added up on the cluster; whole numbers if ``exact``.

    For iterations whose terms are too many for an expression; the driver sees the final vector only.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = block(batch.to_numpy(dtype=float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    total = F.sum(F.col("v").cast("decimal(38,0)") if exact else "v").alias("v")
    rows = df.select(*columns).mapInPandas(partial, f"i long, v {'long' if exact else 'double'}").groupBy("i").agg(total).collect()
    if exact:
        return [int(r["v"]) for r in sorted(rows)]
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def check_bounds(bounds: Bounds | None, columns: list[str] | None = None) -> Bounds:
    """A model without public bounds would have to look them up in the data: refused."""
    if not bounds or any(v is None or len(v) != 2 or not v[0] <= v[1] for v in bounds.values()):
        raise InvalidQuery("public bounds are required for every column; reading them from the data leaks privacy")
    if columns and set(columns) - set(bounds):
        raise InvalidQuery(f"no bounds for {sorted(set(columns) - set(bounds))}")
    return bounds


@dataclass
class Model:
    """A fitted model: small parameters on the driver, predictions as one column expression."""

    def predict_column(self) -> Column:
        raise NotImplementedError

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.predict_column())

    def parameters(self) -> list[tuple[str, int, int, float]]:
        raise NotImplementedError

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Parameters as rows (name, i, j, value)."""
        rows = [(str(n), int(i), int(j), None if v is None else float(v)) for n, i, j, v in self.parameters()]
        return spark.createDataFrame(rows, "name string, i int, j int, value double")


@dataclass
class Estimator:
    epsilon: float

    def __post_init__(self):
        if not self.epsilon > 0:
            raise InvalidQuery("epsilon must be positive")

    def cost(self) -> Cost:
        return Cost(self.epsilon)


def arg_max(scores: list[Column], labels: list) -> Column:
    """Label of the largest score, the first on ties."""
    values = F.array(*scores)
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(values, F.array_max(values)).cast("int"))


def accuracy(df: DataFrame, prediction: str, target: str, epsilon: float, mode: Secure | Seeded, tag: str = "score") -> DataFrame:
    """Noisy share of right predictions: half the budget for the rows, half for the right ones."""
    right = F.when(F.col(prediction) == F.col(target), 1.0).otherwise(0.0)
    sums = noisy_sums(df, {"right": (right, 1.0)}, epsilon, mode, tag, counts=("rows",))
    share = F.when(F.col("rows") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("right") / F.col("rows"))))
    return sums.select(share.alias("accuracy"))


def r_squared(df: DataFrame, prediction: str, target: str, bounds: tuple[float, float], epsilon: float, mode: Secure | Seeded,
              tag: str = "score") -> DataFrame:
    """Noisy R² from residual and total sums of squares on [-1, 1]-scaled values."""
    scaled = unit_scaled({target: bounds, prediction: bounds})
    y, p = scaled[target], scaled[prediction]
    sums = noisy_sums(df, {"sy": (y, 1.0), "syy": (y * y, 1.0), "srr": ((y - p) * (y - p), 4.0)}, epsilon, mode, tag, counts=("rows",))
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("rows")
    return sums.select(F.when((F.col("rows") > 0) & (total > 0), F.lit(1.0) - F.col("srr") / total).alias("r2"))


def one_row(df: DataFrame) -> Row:
    return df.collect()[0]
