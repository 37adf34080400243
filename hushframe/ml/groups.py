"""Private models whose fit is a grouped aggregation: naive Bayes, trees, forests and k-means."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.literals import constant_table
from hushframe.functions.noise import Noise, Secure, Seeded, add_noise
from hushframe.functions.uniform import uniform_slot
from hushframe.ml.base import Bounds, Estimator, Model, arg_max, check_bounds, noisy_sums, unit_scaled
from hushframe.operators.domain import clamped, complete


def plain_uniform(*parts) -> float:
    """The driver-side twin of ``functions.uniform``, for data-independent choices."""
    text = "|".join(map(str, parts))
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52


# -- Gaussian naive Bayes ------------------------------------------------------------------------------------


@dataclass
class NaiveBayesModel(Model):
    features: list[str]
    classes: list
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]
    bounds: Bounds

    def predict_column(self) -> Column:
        u = list(unit_scaled({c: self.bounds[c] for c in self.features}).values())
        scores = []
        for prior, means, variances in zip(self.priors, self.means, self.variances):
            score = F.lit(math.log(prior))
            for c, m, v in zip(u, means, variances):
                score = score - F.lit(0.5 * math.log(2.0 * math.pi * v)) - (c - F.lit(m)) * (c - F.lit(m)) / F.lit(2.0 * v)
            scores.append(score)
        return arg_max(scores, self.classes)

    def parameters(self):
        rows = [("prior", k, 0, p) for k, p in enumerate(self.priors)]
        for name, table in (("mean", self.means), ("variance", self.variances)):
            rows += [(name, k, i, v) for k, r in enumerate(table) for i, v in enumerate(r)]
        return rows


@dataclass
class DPGaussianNB(Estimator):
    """Per public class one count and two sums per column; means and variances on the [-1, 1] scale."""

    bounds: Bounds | None = None
    classes: list = field(default_factory=list)
    priors: list[float] | None = None
    smallest_variance: float = 1e-6
    tag: str = "bayes"

    def fit(self, df: DataFrame, target: str, mode: Secure | Seeded) -> NaiveBayesModel:
        bounds = check_bounds(self.bounds)
        if not self.classes:
            raise InvalidQuery("public classes are required")
        u, sums = unit_scaled(bounds), {}
        for i, c in enumerate(bounds):
            sums[f"s{i}"], sums[f"q{i}"] = (u[c], 1.0), (u[c] * u[c], 1.0)
        table = noisy_sums(df, sums, self.epsilon, mode, self.tag, by={target: self.classes}, counts=("n",))
        by_class = {r[target]: r for r in table.collect()}
        sizes, means, variances = [], [], []
        for k in self.classes:
            r, n = by_class[k], max(by_class[k]["n"], 1.0)
            sizes.append(n)
            mean = [min(1.0, max(-1.0, r[f"s{i}"] / n)) for i in range(len(bounds))]
            means.append(mean)
            variances.append([max(self.smallest_variance, min(1.0, r[f"q{i}"] / n - m * m)) for i, m in enumerate(mean)])
        priors = list(self.priors) if self.priors else [n / sum(sizes) for n in sizes]
        return NaiveBayesModel(list(bounds), list(self.classes), priors, means, variances, bounds)


# -- trees ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Splits:
    """A tree shape drawn from (seed, bounds) alone: feature and threshold of every inner node, heap order."""

    features: tuple[str, ...]
    thresholds: tuple[float, ...]
    depth: int

    @classmethod
    def draw(cls, bounds: Bounds, depth: int, seed: int, tree: int = 0) -> Splits:
        names, features, thresholds = list(bounds), [], []
        boxes = [dict(bounds)]
        for node in range(2**depth - 1):
            box = boxes[node]
            name = names[int(plain_uniform(seed, "feature", tree, node) * len(names))]
            low, high = box[name]
            cut = low + plain_uniform(seed, "cut", tree, node) * (high - low)
            features.append(name)
            thresholds.append(cut)
            boxes += [{**box, name: (low, cut)}, {**box, name: (cut, high)}]
        return cls(tuple(features), tuple(thresholds), depth)

    def leaf(self) -> Column:
        """Leaf number 0 … 2^depth - 1; a missing value goes right."""
        def walk(node: int) -> Column:
            if node >= len(self.features):
                return F.lit(node - len(self.features))
            return F.when(F.col(self.features[node]) < F.lit(self.thresholds[node]), walk(2 * node + 1)).otherwise(walk(2 * node + 2))
        return walk(0)


MAX_CASE_NODES = 64


def walk(trees: list[Splits], tree: Column) -> Column:
    """Leaf number of a row in tree number ``tree``, by following literal arrays: short code for large forests."""
    names = list(dict.fromkeys(f for t in trees for f in t.features))
    row = F.array(*[F.col(c).cast("double") for c in names])
    features = constant_table([[names.index(f) + 1 for f in t.features] for t in trees])
    cuts = constant_table([t.thresholds for t in trees])
    mine, at = F.element_at(features, tree + 1), F.element_at(cuts, tree + 1)

    def step(node: Column, _: Column) -> Column:
        left = F.element_at(row, F.element_at(mine, node + 1)) < F.element_at(at, node + 1)
        return node * 2 + F.when(left, 1).otherwise(2)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(trees[0].depth)), F.lit(0), step)
    return last - len(trees[0].features)


def leaf_of(trees: list[Splits], tree: Column) -> Column:
    """Leaf of a row in its tree; few nodes stay a CASE expression inside generated code."""
    if len(trees) == 1 and len(trees[0].features) <= MAX_CASE_NODES:
        return trees[0].leaf()
    if sum(len(t.features) for t in trees) > MAX_CASE_NODES:
        return walk(trees, tree)
    return F.coalesce(*[F.when(tree == i, t.leaf()) for i, t in enumerate(trees)])


@dataclass
class ForestModel(Model):
    trees: list[Splits]
    classes: list
    leaves: list[list[int]]  # class number per tree and leaf

    def predict_column(self) -> Column:
        labels = constant_table(self.leaves)
        votes = F.transform(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)),
                            lambda t: F.element_at(F.element_at(labels, t + 1), leaf_of(self.trees, t) + 1))
        if len(self.trees) == 1:
            return F.element_at(F.array(*map(F.lit, self.classes)), votes[0] + 1)
        tally = F.transform(F.sequence(F.lit(0), F.lit(len(self.classes) - 1)), lambda k: F.size(F.filter(votes, lambda v: v == k)))
        return F.element_at(F.array(*map(F.lit, self.classes)), F.array_position(tally, F.array_max(tally)).cast("int"))

    def parameters(self):
        rows = []
        for t, (splits, labels) in enumerate(zip(self.trees, self.leaves)):
            rows += [("threshold", t, i, v) for i, v in enumerate(splits.thresholds)]
            rows += [("leaf_class", t, i, v) for i, v in enumerate(labels)]
        return rows


@dataclass
class DPRandomForest(Estimator):
    """Each row feeds one tree (chosen by a hash of its key), so every tree gets the whole budget.

    Splits do not look at data; a leaf takes the class of the largest noisy count (exponential mechanism).
    """

    bounds: Bounds | None = None
    classes: list = field(default_factory=list)
    n_estimators: int = 10
    depth: int = 4
    seed: int = 0
    tag: str = "forest"

    def shapes(self) -> list[Splits]:
        return [Splits.draw(check_bounds(self.bounds), self.depth, self.seed, t) for t in range(self.n_estimators)]

    def counts(self, df: DataFrame, target: str, key: list[str]) -> DataFrame:
        """Rows per (tree, leaf, class) over the public domain; private."""
        if not self.classes:
            raise InvalidQuery("public classes are required")
        if self.n_estimators > 1 and not key:
            raise InvalidQuery("a forest needs key columns to spread rows over its trees")
        shapes = self.shapes()
        tree = uniform_slot(len(shapes), self.seed, "tree", *key) if len(shapes) > 1 else F.lit(0)
        leaf = leaf_of(shapes, F.col("tree"))
        label = F.array_position(F.array(*map(F.lit, self.classes)), F.col(target)).cast("int") - 1
        used = list(dict.fromkeys([*self.bounds, target, *key]))
        routed = df.select(*used).withColumn("tree", tree).select("tree", leaf.alias("leaf"), label.alias("label"))
        grouped = routed.filter(F.col("label") >= 0).groupBy("tree", "leaf", "label").agg(F.count("*").alias("n"))
        domain = {"tree": list(range(len(shapes))), "leaf": list(range(2**self.depth)), "label": list(range(len(self.classes)))}
        return complete(grouped, domain, ["n"])

    def leaf_classes(self, df: DataFrame, target: str, key: list[str], mode: Secure | Seeded) -> DataFrame:
        # all counts move the same way when a row comes or goes, so the temperature is 1/epsilon
        noisy = add_noise(self.counts(df, target, key), [Noise("n", "gumbel", 1.0 / self.epsilon)], ["tree", "leaf", "label"], mode, self.tag)
        return noisy.groupBy("tree", "leaf").agg(F.max_by("label", F.struct("n", "label")).alias("label"))

    def fit(self, df: DataFrame, target: str, mode: Secure | Seeded, key: list[str] | None = None) -> ForestModel:
        leaves = [[0] * 2**self.depth for _ in range(self.n_estimators)]
        for r in self.leaf_classes(df, target, key or [], mode).collect():
            leaves[r["tree"]][r["leaf"]] = r["label"]
        return ForestModel(self.shapes(), list(self.classes), leaves)


@dataclass
class DPDecisionTree(DPRandomForest):
    n_estimators: int = 1
    tag: str = "tree"


# -- k-means -------------------------------------------------------------------------------------------------


@dataclass
class KMeansModel(Model):
    centers: list[list[float]]
    bounds: Bounds

    def predict_column(self) -> Column:
        return nearest(list(unit_scaled(self.bounds).values()), self.scaled())

    def transform(self, df: DataFrame, prefix: str = "distance") -> DataFrame:
        """Distance of the clamped row to every centre, missing values at the middle of their bounds."""
        values = [F.coalesce(clamped(c, *b).cast("double"), F.lit((b[0] + b[1]) / 2.0)) for c, b in self.bounds.items()]
        squares = [sum(((v - F.lit(x)) * (v - F.lit(x)) for v, x in zip(values, center)), F.lit(0.0)) for center in self.centers]
        return df.withColumns({f"{prefix}{k}": F.sqrt(s) for k, s in enumerate(squares)})

    def scaled(self) -> list[list[float]]:
        spans = [((a + b) / 2.0, (b - a) / 2.0 or 1.0) for a, b in self.bounds.values()]
        return [[(v - m) / h for v, (m, h) in zip(c, spans)] for c in self.centers]

    def parameters(self):
        return [("center", k, i, v) for k, c in enumerate(self.centers) for i, v in enumerate(c)]


def nearest(columns: list[Column], centers: list[list[float]]) -> Column:
    """Number of the closest centre, the first on ties."""
    if len(columns) * len(centers) > MAX_CASE_NODES:
        row, table = F.array(*columns), constant_table(centers)
        squares = F.transform(table, lambda c: F.aggregate(F.zip_with(row, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        return (F.array_position(squares, F.array_min(squares)) - 1).cast("int")
    distances = []
    for center in centers:
        total = None
        for c, v in zip(columns, center):
            part = (c - F.lit(v)) * (c - F.lit(v))
            total = part if total is None else total + part
        distances.append(total)
    values = F.array(*distances)
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


@dataclass
class DPKMeans(Estimator):
    """Lloyd's steps with noisy sizes and sums; a fixed number of steps shares the budget.

    Starting centres are drawn from the bounds.  Each step is one scan with partial aggregation to k rows.
    """

    k: int = 8
    bounds: Bounds | None = None
    iterations: int = 5
    seed: int = 0
    tag: str = "kmeans"

    def start(self) -> list[list[float]]:
        return [[2.0 * plain_uniform(self.seed, "center", k, i) - 1.0 for i in range(len(self.bounds))] for k in range(self.k)]

    def step(self, df: DataFrame, centers: list[list[float]], number: int, mode: Secure | Seeded) -> DataFrame:
        """Noisy size ``n`` and sums ``s0…`` per cluster."""
        u = unit_scaled(self.bounds)
        rows = df.select(*[c.alias(f"u{i}") for i, c in enumerate(u.values())])
        columns = [F.col(f"u{i}") for i in range(len(u))]
        rows = rows.withColumn("cluster", nearest(columns, centers))
        sums = {f"s{i}": (c, 1.0) for i, c in enumerate(columns)}
        return noisy_sums(rows, sums, self.epsilon / self.iterations, mode, f"{self.tag}{number}", by={"cluster": list(range(self.k))}, counts=("n",))

    def fit(self, df: DataFrame, mode: Secure | Seeded) -> KMeansModel:
        bounds = check_bounds(self.bounds)
        centers = self.start()
        for number in range(self.iterations):
            for r in self.step(df, centers, number, mode).collect():
                if r["n"] >= 1.0:
                    centers[r["cluster"]] = [min(1.0, max(-1.0, r[f"s{i}"] / r["n"])) for i in range(len(bounds))]
        spans = [((a + b) / 2.0, (b - a) / 2.0 or 1.0) for a, b in bounds.values()]
        return KMeansModel([[m + h * v for v, (m, h) in zip(c, spans)] for c in centers], bounds)
