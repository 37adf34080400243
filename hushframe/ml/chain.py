"""Steps fitted one after the other on Spark, their budgets added up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.noise import Secure, Seeded
from hushframe.ml.base import Model, accuracy, noisy_sums, one_row, r_squared, unit_scaled
from hushframe.ml.groups import DPGaussianNB, DPKMeans, DPRandomForest, KMeansModel
from hushframe.ml.linear import DPPCA, DPLinearRegression, DPLogisticRegression, DPStandardScaler, LinearModel, PCAModel
from hushframe.operators.clean import impute, missing, select_cols
from hushframe.operators.domain import clamped
from hushframe.operators.post import split
from hushframe.plans.accounting import Cost


@dataclass
class FittedChain:
    steps: list[Model]
    features: list[str]
    target: str | None
    test: DataFrame
    target_bounds: tuple[float, float] | None = None
    bounds: dict | None = None

    @property
    def model(self) -> Model:
        return self.steps[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps[:-1]:
            df = step.transform(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(self.transform(df))

    def score(self, epsilon: float, mode: Secure | Seeded) -> DataFrame:
        """Noisy score on the part kept out of training, with its own budget.

        Accuracy, R² for a regression; without a target the mean squared distance to the nearest centre, or to
        the plane of the components.
        """
        if self.target is None:
            if not isinstance(self.model, (KMeansModel, PCAModel)):
                raise InvalidQuery("a score needs a target column")
            return mean_distance(self.transform(self.test), self.model, self.bounds, epsilon, mode)
        scored = self.predict(self.test)
        if isinstance(self.model, LinearModel):
            return r_squared(scored, "prediction", self.target, self.target_bounds, epsilon, mode)
        return accuracy(scored, "prediction", self.target, epsilon, mode)


@dataclass
class DPPipeline:
    """Scalers, components and distances to centres first, then one estimator; ``target=None`` for unsupervised estimators.

    Missing values are dropped, or replaced by noisy means within the bounds of the first step that declares some
    (``imputer="mean"``), which ``imputer_epsilon`` pays for.  Exact statistics of the table are not read.
    """

    steps: list
    imputer_epsilon: float = 0.0

    def cost(self) -> Cost:
        if not self.steps:
            raise InvalidQuery("no step")
        return sum((s.cost() for s in self.steps[1:]), self.steps[0].cost() + Cost(self.imputer_epsilon))

    def _imputed(self, df: DataFrame, features: list[str], imputer: str, mode: Secure | Seeded) -> DataFrame:
        if imputer == "drop":
            return impute(df, imputer)
        bounds = next((s.bounds for s in self.steps if getattr(s, "bounds", None)), None)
        known = [c for c in features if c in (bounds or {})]
        if imputer != "mean" or self.imputer_epsilon <= 0 or not known:
            raise InvalidQuery("a private pipeline drops missing values, or fills in noisy means with an imputer_epsilon and bounds")
        return noisy_means_filled(df, known, bounds, self.imputer_epsilon, mode)

    def fit(self, df: DataFrame, features: list[str], target: str | None, key: list[str], mode: Secure | Seeded,
            test_size: float = 0.2, seed: int = 1, imputer: str = "drop") -> FittedChain:
        self.cost()
        used = list(dict.fromkeys([*features, *([target] if target else []), *key]))
        train, test = split(self._imputed(select_cols(df, used), features, imputer, mode), key, test_size, seed)
        fitted, data = [], train
        for i, step in enumerate(self.steps):
            last = i == len(self.steps) - 1
            if isinstance(step, (DPStandardScaler, DPPCA, DPKMeans)) and not last:
                model = step.fit(data, mode)
                data = model.transform(data)
                if isinstance(step, DPPCA):
                    features = [f"pc{k}" for k in range(len(model.components))]
                elif isinstance(step, DPKMeans):
                    features = [f"distance{k}" for k in range(step.k)]
            elif last:
                model = _fit(step, data, features, target, key, mode)
            else:
                raise InvalidQuery("only scalers, components and centres may come before the last step")
            fitted.append(model)
        return FittedChain(fitted, list(features), target, test, getattr(self.steps[-1], "target_bounds", None), getattr(self.steps[-1], "bounds", None))


def noisy_means_filled(df: DataFrame, columns: list[str], bounds: dict, epsilon: float, mode: Secure | Seeded, tag: str = "impute") -> DataFrame:
    """Missing numbers replaced by noisy means, which cost ``epsilon`` altogether; rows with other gaps are dropped."""
    unit = unit_scaled({c: bounds[c] for c in columns})
    gap = {c: missing(c, df.schema[c].dataType) for c in columns}
    sums = {f"s_{c}": (F.when(gap[c], 0.0).otherwise(unit[c]), 1.0) for c in columns} | {f"n_{c}": (F.when(gap[c], 0.0).otherwise(1.0), 1.0) for c in columns}
    row = one_row(noisy_sums(df, sums, epsilon, mode, tag)).asDict()
    fills = {}
    for c in columns:
        low, high = bounds[c]
        mean = row[f"s_{c}"] / row[f"n_{c}"] if row[f"n_{c}"] >= 1 else 0.0
        fills[c] = (low + high) / 2.0 + (high - low) / 2.0 * min(1.0, max(-1.0, mean))
    filled = df.select(*[F.when(gap[c], F.lit(fills[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fills else F.col(c) for c in df.columns])
    return impute(filled, "drop")


def mean_distance(df: DataFrame, model: Model, bounds: dict, epsilon: float, mode: Secure | Seeded, tag: str = "score") -> DataFrame:
    """Noisy mean squared distance of clamped rows to an unsupervised model, in the columns' own units."""
    most = sum((high - low) ** 2 for low, high in bounds.values()) or 1.0
    values = {c: F.coalesce(clamped(c, *b).cast("double"), F.lit((b[0] + b[1]) / 2.0)) for c, b in bounds.items()}
    if isinstance(model, KMeansModel):
        squares = [sum(((values[c] - F.lit(v)) ** 2 for c, v in zip(bounds, center)), F.lit(0.0)) for center in model.centers]
        distance = F.least(*squares) if len(squares) > 1 else squares[0]
    else:
        off = [values[c] - F.lit(m) for c, m in zip(model.features, model.mean)]
        along = [sum((F.lit(w) * x for w, x in zip(row, off)), F.lit(0.0)) for row in model.components]
        distance = sum((x * x for x in off), F.lit(0.0)) - sum((a * a for a in along), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance / F.lit(most)))
    sums = noisy_sums(df, {"d": (share, 1.0)}, epsilon, mode, tag, counts=("rows",))
    return sums.select((F.when(F.col("rows") > 0, F.greatest(F.lit(0.0), F.col("d") / F.col("rows"))) * F.lit(most)).alias("mean_squared_distance"))


def _fit(step, data: DataFrame, features: list[str], target: str | None, key: list[str], mode) -> Model:
    if isinstance(step, (DPKMeans, DPPCA, DPStandardScaler)):
        return step.fit(data, mode)
    if target is None:
        raise InvalidQuery("this estimator needs a target column")
    if isinstance(step, DPLogisticRegression):
        return step.fit(data, features, target, mode)
    if isinstance(step, DPRandomForest):
        return step.fit(data, target, mode, key)
    if isinstance(step, (DPLinearRegression, DPGaussianNB)):
        return step.fit(data.filter(F.col(target).isNotNull()), target, mode)
    raise InvalidQuery(f"unknown step {type(step).__name__}")
