"""Private scaling, linear and logistic regression, and principal components."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery, LibraryFailure
from hushframe.functions.exact import exact_sum
from hushframe.functions.noise import Noise, Secure, Seeded, add_noise
from hushframe.ml import base
from hushframe.ml.base import Bounds, Estimator, Model, arg_max, check_bounds, noisy_products, noisy_sums, one_row, partition_sums, unit_scaled
from hushframe.ml.groups import plain_uniform
from hushframe.operators.domain import clamped

GRID = 1e9  # a row's share of a gradient or curvature is at most one


@dataclass
class ScalerModel(Model):
    means: dict[str, float]
    stds: dict[str, float]
    bounds: Bounds

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(self.stds[c]) for c, m in self.means.items()}
        return df.withColumns(scaled)

    def scaled_bounds(self) -> Bounds:
        return {c: tuple((b - self.means[c]) / self.stds[c] for b in self.bounds[c]) for c in self.means}

    def parameters(self):
        return [(kind, i, 0, values[c]) for kind, values in (("mean", self.means), ("std", self.stds)) for i, c in enumerate(values)]


@dataclass
class DPStandardScaler(Estimator):
    """Means and deviations from one count and two sums per column."""

    bounds: Bounds | None = None
    tag: str = "scaler"

    def fit(self, df: DataFrame, mode: Secure | Seeded) -> ScalerModel:
        bounds = check_bounds(self.bounds)
        u = unit_scaled(bounds)
        sums = {}
        for i, c in enumerate(bounds):
            sums[f"s{i}"], sums[f"q{i}"] = (u[c], 1.0), (u[c] * u[c], 1.0)
        row = one_row(noisy_sums(df, sums, self.epsilon, mode, self.tag, counts=("n",)))
        means, stds = {}, {}
        for i, (c, (low, high)) in enumerate(bounds.items()):
            middle, half, n = (low + high) / 2.0, (high - low) / 2.0 or 1.0, max(row["n"], 1.0)
            mean = min(1.0, max(-1.0, row[f"s{i}"] / n))
            spread = min(1.0, max(0.0, row[f"q{i}"] / n - mean * mean))
            means[c], stds[c] = middle + half * mean, half * math.sqrt(spread) or 1.0
        return ScalerModel(means, stds, bounds)


@dataclass
class LinearModel(Model):
    features: list[str]
    coefficients: list[float]
    intercept: float
    bounds: Bounds

    def predict_column(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in zip(self.features, self.coefficients):
            out = out + F.lit(w) * clamped(c, *self.bounds[c]).cast("double")
        return out

    def parameters(self):
        return [("intercept", 0, 0, self.intercept)] + [("coefficient", i, 0, w) for i, w in enumerate(self.coefficients)]


@dataclass
class DPLinearRegression(Estimator):
    """Least squares from noisy second moments of [-1, 1]-scaled columns (Zhang et al. 2012)."""

    bounds: Bounds | None = None
    target_bounds: tuple[float, float] | None = None
    ridge: float = 1e-3
    tag: str = "linear"

    def moments(self, df: DataFrame, target: str, mode: Secure | Seeded) -> DataFrame:
        """Noisy sums of products of (1, x…, y); one row, columns ``m_i_j`` with i <= j, 0 the constant."""
        columns = unit_scaled({**check_bounds(self.bounds), target: check_bounds({target: self.target_bounds})[target]})
        terms = [F.lit(1.0), *columns.values()]
        last = len(terms) - 1
        pairs = [(i, j) for i in range(last) for j in range(i, last + 1)]
        return noisy_products(df, terms, pairs, "m", self.epsilon, mode, self.tag)

    def fit(self, df: DataFrame, target: str, mode: Secure | Seeded) -> LinearModel:
        row = one_row(self.moments(df, target, mode))
        d = len(self.bounds) + 1
        gram = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        moment = np.array([row[f"m_{i}_{d}"] for i in range(d)])
        # noise may break definiteness: lift small eigenvalues before solving
        values, vectors = np.linalg.eigh(gram)
        floor = self.ridge * max(float(values.max()), 1.0)
        w = vectors @ ((vectors.T @ moment) / np.maximum(values, floor))
        low, high = self.target_bounds
        middle, half = (low + high) / 2.0, (high - low) / 2.0 or 1.0
        coefficients, intercept = [], float(w[0])
        for weight, (a, b) in zip(w[1:], self.bounds.values()):
            centre, reach = (a + b) / 2.0, (b - a) / 2.0 or 1.0
            coefficients.append(float(half * weight / reach))
            intercept -= float(weight * centre / reach)
        return LinearModel(list(self.bounds), coefficients, middle + half * intercept, dict(self.bounds))


@dataclass
class LogisticModel(Model):
    features: list[str]
    classes: list
    weights: list[list[float]]  # one row per class: a weight per feature, then the constant
    data_norm: float

    def predict_column(self) -> Column:
        x = _unit_ball(self.features, self.data_norm)
        scores = []
        for w in self.weights:
            score = F.lit(w[-1])
            for c, weight in zip(x, w):
                score = score + F.lit(weight) * c
            scores.append(score)
        return arg_max(scores, self.classes)

    def parameters(self):
        return [("weight", k, i, w) for k, row in enumerate(self.weights) for i, w in enumerate(row)]


def _unit_ball(features: list[str], norm: float) -> list[Column]:
    """Rows clipped to the public norm and scaled into the unit ball; missing values become 0."""
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]
    square = x[0] * x[0]
    for c in x[1:]:
        square = square + c * c
    size = F.greatest(F.sqrt(square), F.lit(float(norm)))
    return [c / size for c in x]


@dataclass
class DPLogisticRegression(Estimator):
    """One-vs-rest logistic regression by objective perturbation (Chaudhuri et al. 2011).

    Every Newton step is one pass that adds gradient and curvature of all classes on the cluster, as whole numbers of a
    grid: the fit does not depend on how the rows lie.
    """

    data_norm: float | None = None
    classes: list = field(default_factory=list)
    C: float = 1.0
    tol: float = 1e-4
    max_iter: int = 100

    def fit(self, df: DataFrame, features: list[str], target: str, mode: Secure | Seeded) -> LogisticModel:
        if not self.data_norm or self.data_norm <= 0:
            raise InvalidQuery("data_norm is required; reading it from the data leaks privacy")
        if len(self.classes) < 2:
            raise InvalidQuery("public classes are required")
        outputs = self.classes[1:] if len(self.classes) == 2 else self.classes
        per_class = self.epsilon / len(outputs)
        curvature, alpha = 0.25, 1.0 / self.C
        usable = per_class - 2.0 * math.log1p(curvature / alpha)
        if usable <= 0:
            alpha = curvature / (math.expm1(per_class / 4.0))
            usable = per_class / 2.0
        size = len(features) + 1
        noise = np.array([_ball_noise(mode, k, size, 2.0 / usable) for k in range(len(outputs))])

        # features and a constant share the unit ball
        root = math.sqrt(0.5)
        columns = [(c * F.lit(root)).alias(f"x{i}") for i, c in enumerate(_unit_ball(features, self.data_norm))]
        label = F.array_position(F.array(*map(F.lit, self.classes)), F.col(target)) - 1
        rows = df.select(*columns, label.cast("double").alias("y")).filter(F.col("y") >= 0)
        first = 1 if len(self.classes) == 2 else 0
        w = np.zeros((len(outputs), size))
        for _ in range(self.max_iter):
            weights = w.copy()

            def block(values: np.ndarray, weights=weights) -> np.ndarray:
                x, parts = [*values[:, :-1].T, np.full(len(values), root)], []
                for k, row in enumerate(weights):
                    z = x[0] * row[0]
                    for v, c in zip(x[1:], row[1:]):
                        z = z + v * c  # term by term: a product of matrices rounds as its shape has it
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                    off, bend = p - (values[:, -1] == k + first), p * (1.0 - p)
                    parts += [np.floor(off * v * GRID + 0.5).astype(np.int64).sum() for v in x]
                    parts += [np.floor(bend * x[i] * x[j] * GRID + 0.5).astype(np.int64).sum() for i in range(size) for j in range(i, size)]
                return np.array(parts)

            sums = np.array(partition_sums(rows, rows.columns, block, exact=True), float) / GRID
            if not len(sums):
                raise LibraryFailure("no row carries a known class")
            step, width = np.zeros_like(w), size + size * (size + 1) // 2
            for k in range(len(outputs)):
                part, bend = sums[k * width:(k + 1) * width], np.zeros((size, size))
                bend[np.triu_indices(size)] = part[size:]
                bend = bend + np.triu(bend, 1).T + alpha * np.eye(size)
                step[k] = np.linalg.solve(bend, part[:size] + alpha * w[k] + noise[k])
            w = w - step
            if np.abs(step).max() < self.tol * max(1.0, np.abs(w).max()):
                break
        else:  # objective perturbation is private at the optimum only
            raise LibraryFailure(f"no optimum after {self.max_iter} steps")
        if len(self.classes) == 2:
            w = np.vstack([-w[0], w[0]])
        return LogisticModel(list(features), list(self.classes), (root * w).tolist(), float(self.data_norm))


def _ball_noise(mode: Secure | Seeded, k: int, size: int, scale: float) -> np.ndarray:
    """Density proportional to exp(-|b| / scale): uniform direction, Gamma length of whole shape."""
    source = random.SystemRandom()

    def draw(*tag) -> float:
        return plain_uniform(mode.seed, "logistic", k, *tag) if isinstance(mode, Seeded) else 1.0 - source.random()

    direction = np.array([math.sqrt(-2.0 * math.log(draw("u", i))) * math.cos(2.0 * math.pi * draw("v", i)) for i in range(size)])
    length = -scale * sum(math.log(draw("g", i)) for i in range(size))
    return direction / math.sqrt(sum(direction**2)) * length


@dataclass
class PCAModel(Model):
    features: list[str]
    components: list[list[float]]
    explained_variance: list[float]
    explained_variance_ratio: list[float]
    singular_values: list[float]
    mean: list[float]
    noise_variance: float

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        out = {}
        for k, row in enumerate(self.components):
            value = F.lit(0.0)
            for c, w, m in zip(self.features, row, self.mean):
                value = value + F.lit(w) * (F.col(c).cast("double") - F.lit(m))
            out[f"{prefix}{k}"] = value
        return df.withColumns(out)

    def parameters(self):
        rows = [("component", k, i, v) for k, r in enumerate(self.components) for i, v in enumerate(r)]
        for name in ("explained_variance", "explained_variance_ratio", "singular_values", "mean"):
            rows += [(name, i, 0, v) for i, v in enumerate(getattr(self, name))]
        return [*rows, ("noise_variance", 0, 0, self.noise_variance)]


@dataclass
class DPPCA(Estimator):
    """Eigenvectors of a noisy covariance; rows are centred at the bounds' middle and clipped to a norm."""

    n_components: int = 2
    bounds: Bounds | None = None
    data_norm: float | None = None
    tag: str = "pca"

    def fit(self, df: DataFrame, mode: Secure | Seeded) -> PCAModel:
        bounds = check_bounds(self.bounds)
        names, d = list(bounds), len(bounds)
        middles = [(low + high) / 2.0 for low, high in bounds.values()]
        halves = [(high - low) / 2.0 for low, high in bounds.values()]
        norm = float(self.data_norm or math.sqrt(sum(h * h for h in halves)))
        x = [F.coalesce(clamped(c, *bounds[c]).cast("double"), F.lit(m)) - F.lit(m) for c, m in zip(names, middles)]
        square = sum((c * c for c in x[1:]), x[0] * x[0])
        size = F.greatest(F.sqrt(square) / F.lit(norm), F.lit(1.0)) * F.lit(norm)
        unit = [c / size for c in x]
        rows = df.select(*[c.alias(f"u{i}") for i, c in enumerate(unit)])
        u = [F.col(f"u{i}") for i in range(d)]
        # one row in the unit ball adds at most sqrt(d) to the first sums and (d + 1) / 2 to the products, in L1
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        firsts = {f"s{i}": (c, 1.0) for i, c in enumerate(u)}
        if len(pairs) <= base.MAX_SUM_COLUMNS:  # one scan: all sums at once, then the three draws with their own scales
            products = {f"p_{i}_{j}": (u[i] * u[j], 1.0) for i, j in pairs}
            exact = rows.agg(F.count(F.lit(1)).alias("n"), *[exact_sum(c, b).alias(k) for k, (c, b) in {**firsts, **products}.items()])
            third = self.epsilon / 3.0
            for drawn, scale, tag in ((firsts, d / (third * math.sqrt(d)), "1"), (products, len(pairs) / (third * d), "2"), (["n"], 1.0 / third, "0")):
                exact = add_noise(exact, [Noise(k, "laplace", scale) for k in drawn], [], mode, self.tag + tag)
            row = one_row(exact).asDict()
        else:
            first = noisy_sums(rows, firsts, self.epsilon / 3.0 * math.sqrt(d), mode, self.tag + "1")
            second = noisy_products(rows, u, pairs, "p", self.epsilon / 3.0 * d, mode, self.tag + "2")
            count = noisy_sums(rows, {}, self.epsilon / 3.0, mode, self.tag + "0", counts=("n",))
            row = {**one_row(first).asDict(), **one_row(second).asDict(), **one_row(count).asDict()}
        n = max(row["n"], 2.0)
        mean = np.array([row[f"s{i}"] / n for i in range(d)])
        product = np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        covariance = (product - n * np.outer(mean, mean)) / (n - 1.0) * norm * norm
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1]
        values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
        k = min(self.n_components, d)
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(d)])
        components = (vectors * signs).T[:k]
        total = float(values.sum()) or 1.0
        return PCAModel(
            names, components.tolist(), values[:k].tolist(), (values[:k] / total).tolist(), np.sqrt(values[:k] * (n - 1.0)).tolist(),
            [m + norm * float(v) for m, v in zip(middles, mean)], float(values[k:].mean()) if k < d else 0.0,
        )
