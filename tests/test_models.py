import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.noise import Secure, Seeded
from hushframe.ml.chain import DPPipeline
from hushframe.ml.groups import DPDecisionTree, DPGaussianNB, DPKMeans, DPRandomForest
from hushframe.ml.linear import DPPCA, DPLinearRegression, DPLogisticRegression, DPStandardScaler

MODE = Seeded(2, allow_insecure=True)
BOUNDS = {"a": (-10.0, 10.0), "b": (0.0, 30.0)}
CLASSES = ["p", "q", "r"]
BIG = 1e6  # so large a budget that the noise vanishes


@pytest.fixture(scope="module")
def rows(spark):
    """Three separated clusters; y is linear in a and b."""
    k, u = F.col("id") % 3, F.sin(F.col("id") * 12.9898) * 2
    v = F.cos(F.col("id") * 78.233) * 2
    df = spark.range(3000).select(
        "id", F.element_at(F.array(*map(F.lit, CLASSES)), (k + 1).cast("int")).alias("c"), (k * 6 - 6 + u).alias("a"), (k * k * 6 + 3 + v).alias("b"))
    return df.withColumn("y", 2 * F.col("a") - F.col("b") + 5).cache()


def right(model, df):
    return model.predict(df).agg(F.avg((F.col("prediction") == F.col("c")).cast("double"))).first()[0]


def test_scaler(spark, rows):
    m = DPStandardScaler(BIG, BOUNDS).fit(rows, MODE)
    pdf = rows.toPandas()
    assert np.allclose([m.means["a"], m.stds["a"]], [pdf["a"].mean(), pdf["a"].std(ddof=0)], atol=1e-3)
    scaled = m.transform(rows).agg(F.avg("a"), F.stddev("b")).first()
    assert abs(scaled[0]) < 1e-3 and abs(scaled[1] - 1) < 1e-2


def test_linear_regression_recovers_the_line(spark, rows):
    m = DPLinearRegression(BIG, BOUNDS, (-50.0, 30.0), ridge=1e-9).fit(rows, "y", MODE)
    assert np.allclose(m.coefficients, [2, -1], atol=1e-2) and abs(m.intercept - 5) < 0.05
    assert [r["name"] for r in m.to_frame(spark).collect()] == ["intercept", "coefficient", "coefficient"]


@pytest.mark.parametrize("mode", [MODE, Secure()], ids=["seeded", "secure"])
def test_classifiers(rows, mode):
    assert right(DPGaussianNB(5.0, BOUNDS, CLASSES).fit(rows, "c", mode), rows) > 0.95
    assert right(DPGaussianNB(5.0, BOUNDS, CLASSES, priors=[0.2, 0.3, 0.5]).fit(rows, "c", mode), rows) > 0.95
    assert right(DPRandomForest(5.0, BOUNDS, CLASSES, n_estimators=15, depth=5, seed=1).fit(rows, "c", mode, ["id"]), rows) > 0.8
    assert right(DPDecisionTree(5.0, BOUNDS, CLASSES, depth=6, seed=1).fit(rows, "c", mode), rows) > 0.7


def test_logistic_regression(rows):
    norm = (10.0**2 + 30.0**2) ** 0.5
    assert right(DPLogisticRegression(50.0, data_norm=norm, classes=CLASSES, C=100.0).fit(rows, ["a", "b"], "c", MODE), rows) > 0.9
    two = rows.filter("c <> 'q'")
    assert right(DPLogisticRegression(50.0, data_norm=norm, classes=["p", "r"], C=100.0).fit(two, ["a", "b"], "c", MODE), two) > 0.95
    weak = DPLogisticRegression(0.01, data_norm=norm, classes=CLASSES).fit(rows, ["a", "b"], "c", MODE)
    strong = DPLogisticRegression(50.0, data_norm=norm, classes=CLASSES).fit(rows, ["a", "b"], "c", MODE)
    assert weak.weights != strong.weights


def test_k_means_and_pca(spark, rows):
    m = DPKMeans(BIG, k=3, bounds=BOUNDS, iterations=8, seed=4).fit(rows, MODE)
    assert all(-10 <= a <= 10 and 0 <= b <= 30 for a, b in m.centers)
    assert m.predict(rows).select("prediction").distinct().count() >= 2
    p = DPPCA(BIG, 2, BOUNDS).fit(rows, MODE)
    pdf = rows.select("a", "b").toPandas()
    values, vectors = np.linalg.eigh(np.cov(pdf.T))
    assert np.allclose(p.explained_variance, values[::-1], rtol=1e-3)
    assert abs(abs(np.dot(p.components[0], vectors[:, 1])) - 1) < 1e-4 and np.allclose(p.mean, pdf.mean(), atol=1e-2)
    assert {r["name"] for r in p.to_frame(spark).collect()} == {"component", "explained_variance", "explained_variance_ratio", "singular_values", "mean", "noise_variance"}
    assert p.transform(rows).columns[-2:] == ["pc0", "pc1"]


def test_chain(rows):
    chain = DPPipeline([DPStandardScaler(2.0, BOUNDS), DPGaussianNB(3.0, {"a": (-3.0, 3.0), "b": (-3.0, 3.0)}, CLASSES)])
    assert chain.cost().epsilon == 5.0
    fitted = chain.fit(rows, ["a", "b"], "c", ["id"], MODE, test_size=0.3, seed=2)
    assert fitted.score(5.0, MODE).first()["accuracy"] > 0.9
    line = DPPipeline([DPLinearRegression(BIG, BOUNDS, (-50.0, 30.0), ridge=1e-9)], imputer_epsilon=BIG).fit(rows, ["a", "b"], "y", ["id"], MODE, imputer="mean")
    assert line.score(BIG, MODE).first()["r2"] > 0.99
    clusters = DPPipeline([DPKMeans(5.0, k=2, bounds=BOUNDS)]).fit(rows, ["a", "b"], None, ["id"], MODE)
    test = clusters.test.toPandas()
    exact = np.min([((test[["a", "b"]].to_numpy() - c) ** 2).sum(axis=1) for c in clusters.model.centers], axis=0).mean()
    assert abs(clusters.score(BIG, MODE).first()["mean_squared_distance"] - exact) < 1e-3 * exact


def test_scores_and_steps_of_components(rows):
    plane = DPPipeline([DPPCA(BIG, 1, BOUNDS)]).fit(rows, ["a", "b"], None, ["id"], MODE)
    x = plane.test.toPandas()[["a", "b"]].to_numpy() - plane.model.mean
    exact = ((x - (x @ np.array(plane.model.components).T) @ np.array(plane.model.components)) ** 2).sum(axis=1).mean()
    assert abs(plane.score(BIG, MODE).first()["mean_squared_distance"] - exact) < 1e-2 * exact
    chain = DPPipeline([DPPCA(BIG, 2, BOUNDS), DPGaussianNB(BIG, {"pc0": (-40.0, 40.0), "pc1": (-40.0, 40.0)}, CLASSES)]).fit(rows, ["a", "b"], "c", ["id"], MODE)
    assert chain.score(BIG, MODE).first()["accuracy"] > 0.9
    with pytest.raises(InvalidQuery):
        DPPipeline([DPStandardScaler(1.0, BOUNDS)]).fit(rows, ["a", "b"], None, ["id"], MODE).score(1.0, MODE)


def test_imputation_of_a_pipeline_is_paid_for(rows):
    holes = rows.withColumn("a", F.when(F.col("id") % 5 != 0, F.col("a")))
    steps = [DPLinearRegression(BIG, BOUNDS, (-50.0, 30.0), ridge=1e-9)]
    assert DPPipeline(steps, imputer_epsilon=2.0).cost().epsilon == BIG + 2.0
    assert DPPipeline(steps, imputer_epsilon=BIG).fit(holes, ["a", "b"], "y", ["id"], MODE, imputer="mean").test.filter("a is null").count() == 0
    for imputer, epsilon in (("mean", 0.0), ("median", 1.0), ("most_frequent", 1.0)):
        with pytest.raises(InvalidQuery):
            DPPipeline(steps, imputer_epsilon=epsilon).fit(holes, ["a", "b"], "y", ["id"], MODE, imputer=imputer)


def test_logistic_regression_stops_at_its_optimum_only(rows):
    with pytest.raises(Exception, match="no optimum"):
        DPLogisticRegression(5.0, data_norm=40.0, classes=CLASSES, max_iter=1).fit(rows, ["a", "b"], "c", MODE)


def test_refusals(rows):
    for bad in (
        lambda: DPStandardScaler(0.0, BOUNDS), lambda: DPStandardScaler(1.0).fit(rows, MODE), lambda: DPLinearRegression(1.0, BOUNDS).fit(rows, "y", MODE),
        lambda: DPLogisticRegression(1.0, classes=CLASSES).fit(rows, ["a"], "c", MODE), lambda: DPLogisticRegression(1.0, data_norm=1.0).fit(rows, ["a"], "c", MODE),
        lambda: DPGaussianNB(1.0, BOUNDS).fit(rows, "c", MODE), lambda: DPRandomForest(1.0, BOUNDS, CLASSES).fit(rows, "c", MODE),
        lambda: DPPipeline([]).cost(), lambda: DPPipeline([DPGaussianNB(1.0, BOUNDS, CLASSES), DPStandardScaler(1.0, BOUNDS)]).fit(rows, ["a", "b"], "c", ["id"], MODE),
        lambda: DPPipeline([DPKMeans(1.0, k=2, bounds=BOUNDS)]).fit(rows, ["a", "nope"], None, ["id"], MODE),
    ):
        with pytest.raises(InvalidQuery):
            bad()


def test_short_and_long_forms_agree(spark, rows, monkeypatch):
    import hushframe.ml.base as base
    import hushframe.ml.groups as groups
    forest = DPRandomForest(5.0, BOUNDS, CLASSES, n_estimators=3, depth=3, seed=1)
    holes = rows.withColumn("a", F.when(F.col("id") % 11 != 0, F.col("a")))
    model, means = forest.fit(holes, "c", MODE, ["id"]), DPKMeans(5.0, k=3, bounds=BOUNDS, iterations=2, seed=4).fit(rows, MODE)
    line = DPLinearRegression(5.0, BOUNDS, (-50.0, 30.0)).fit(rows, "y", MODE)
    components = DPPCA(5.0, 2, BOUNDS).fit(rows, MODE)
    expected = [[r["prediction"] for r in m.predict(holes).select("prediction").collect()] for m in (model, means)]
    monkeypatch.setattr(groups, "MAX_CASE_NODES", 0)
    monkeypatch.setattr(base, "MAX_SUM_COLUMNS", 0)
    assert forest.fit(holes, "c", MODE, ["id"]).leaves == model.leaves
    assert [[r["prediction"] for r in m.predict(holes).select("prediction").collect()] for m in (model, means)] == expected
    assert DPLinearRegression(5.0, BOUNDS, (-50.0, 30.0)).fit(rows.repartition(5), "y", MODE).coefficients == line.coefficients
    assert DPPCA(5.0, 2, BOUNDS).fit(rows.repartition(3), MODE).explained_variance == components.explained_variance
