from itertools import product as product_of

import pytest
from pyspark.sql import functions as F

from gate.core import CUSTOMER
from hushframe.errors import InvalidQuery, LibraryFailure
from hushframe.functions.noise import Secure, Seeded
from hushframe.functions.transform import Bins, Clamp
from hushframe.metadata import TableMeta
from hushframe.synth.fidelity import fidelity
from hushframe.synth.aim import aim
from hushframe.synth.factors import Factor, FactorModel, clique_cells, draw_order, sample
from hushframe.synth.mst import fit_mst, mst
from hushframe.synth.prepare import check_request, synth_encode
from hushframe.synth.weights import mwem

MODE = Seeded(3, allow_insecure=True)
META = TableMeta.from_dict({"rows": 4000, "columns": {
    "g": {"type": "string", "cardinality": 3, "categories": ["a", "b", "c"]}, "h": {"type": "int", "precision": 32, "cardinality": 3, "categories": [1, 2, 3]},
    "x": {"type": "float", "precision": 64, "lower": 0.0, "upper": 10.0}}})


@pytest.fixture(scope="module")
def rows(spark):
    """h copies g for nine rows in ten; x is small for g = a."""
    i = F.col("id")
    g = F.floor(F.pmod(F.hash("id"), F.lit(100)) / 34).cast("int")
    return spark.range(4000).select(
        F.element_at(F.array(*map(F.lit, "abc")), g + 1).alias("g"), F.when(i % 10 == 0, (g + 1) % 3 + 1).otherwise(g + 1).alias("h"),
        F.when(g == 0, (i % 3).cast("double")).otherwise(5 + (i % 5).cast("double")).alias("x")).cache()


def distances(a, b):
    return {r["column"]: r["distance"] for r in fidelity(a, b, synth_encode(a, META, ["g", "h", "x"]).plan).collect()}


def agreement(df):
    return df.agg(F.avg(((F.col("g") == "a") == (F.col("x") < 5)).cast("double"))).first()[0]


@pytest.mark.parametrize("mode", [MODE, Secure()], ids=["seeded", "secure"])
@pytest.mark.parametrize("fit", [fit_mst, aim], ids=["mst", "aim"])
def test_forest_synthesizers_keep_marginals_and_dependence(spark, rows, fit, mode):
    out = sample(fit(rows, META, None, 5.0, 1e-5, mode), spark, 4000, seed=1)
    assert out.columns == ["g", "h", "x"] and out.count() == 4000 and out.dtypes == rows.select("g", "h", "x").dtypes
    assert max(distances(rows, out).values()) < 0.06
    assert agreement(out) > 0.9


def test_weights_synthesizer(spark, rows):
    model = mwem(rows, META, None, 50.0, MODE, iterations=25)
    out = sample(model, spark, 4000, seed=1)
    assert out.count() == 4000 and max(distances(rows, out).values()) < 0.25
    assert model.draw_codes(spark, 500, 1).select("id").distinct().count() == 500
    assert model.to_frame(spark).count() == 3 * 3 * 10


@pytest.mark.parametrize("measure_only", [False, True])
def test_weights_of_components(spark, rows, measure_only):
    model = mwem(rows, META, None, 60.0, MODE, iterations=12, split_factor=2, measure_only=measure_only)
    assert sorted(f.table.count() for f in model.factors) == [9, 10]  # no table over all columns
    out = sample(model, spark, 4000, seed=1)
    assert out.count() == 4000 and max(distances(rows, out).values()) < 0.3
    if measure_only:
        assert max(distances(rows, out).values()) < 0.15 and out.filter("ascii(g) - 96 = h").count() > 1600
    with pytest.raises(InvalidQuery):
        mwem(rows, META, None, 1.0, MODE, split_factor=0)


def test_small_budget_means_larger_distance(spark, rows):
    far = distances(rows, sample(fit_mst(rows, META, None, 0.001, 1e-9, MODE), spark, 4000, seed=1))
    near = distances(rows, sample(fit_mst(rows, META, None, 20.0, 1e-5, MODE), spark, 4000, seed=1))
    assert sum(far.values()) > sum(near.values())


def test_conditions_and_sizes(spark, rows):
    model = fit_mst(rows, META, None, 5.0, 1e-5, MODE)
    assert sample(model, spark).count() == 200
    some = sample(model, spark, 150, "x > 7 AND g = 'b'", seed=2)
    assert some.count() == 150 and some.filter("x <= 7 or g <> 'b'").count() == 0
    assert mst(rows, META, ["g", "x"], 1.0, 1e-5, MODE, n=10, seed=1).columns == ["g", "x"]
    assert sorted(sample(model, spark, 50, seed=9).collect()) == sorted(sample(model, spark, 50, seed=9).collect())


def test_rare_condition_is_met_by_every_row(spark):
    """Twenty independent fair columns: all ones have probability 1e-6."""
    names = [f"c{k}" for k in range(20)]
    meta = TableMeta.from_dict({"rows": 100, "columns": {c: {"type": "int", "precision": 32, "cardinality": 2, "categories": [0, 1]} for c in names}})
    half = lambda v: spark.createDataFrame([(0, 0.5), (1, 0.5)], f"{v} int, w double")
    encoded = synth_encode(spark.createDataFrame([], ", ".join(f"{c} int" for c in names)), meta)
    model = FactorModel(encoded, [Factor((c,), half(c), c) for c in names], names, {c: c for c in names}, {c: c for c in names})
    rows = sample(model, spark, 300, [f"{c} = 1" for c in names], seed=4)
    assert rows.count() == 300 and rows.distinct().collect() == [tuple([1] * 20)]
    assert sample(model, spark, 50, "c3 = c4 AND c5 <> c3", seed=4).filter("c3 <> c4 or c5 = c3").count() == 0
    assert sample(model, spark, 5, "1 = 1", seed=4).count() == 5
    for bad in ("c3 > 1", "1 = 2", ["c1 = 0", "c1 = 1"]):
        with pytest.raises(LibraryFailure):
            sample(model, spark, 5, bad, seed=4)


def test_conditioned_rows_follow_the_model_given_the_condition(spark):
    """Against all cells of a small model with a cycle: shares of sampled rows, with and without a condition on two columns."""
    meta = TableMeta.from_dict({"rows": 100, "columns": {c: {"type": "int", "precision": 32, "cardinality": 3, "categories": [0, 1, 2]} for c in "abcd"}})
    encoded = synth_encode(spark.createDataFrame([], "a int, b int, c int, d int"), meta)
    weight = lambda x, y, k: 1.0 + ((3 * x + 5 * y + k) % 7)
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    factors = [Factor(e, spark.createDataFrame([(x, y, weight(x, y, k)) for x in range(3) for y in range(3)], f"{e[0]} int, {e[1]} int, w double")) for k, e in enumerate(edges)]
    model = FactorModel(encoded, factors, list("abcd"), {c: c for c in "abcd"}, {c: c for c in "abcd"})
    for condition, holds in ((None, lambda a, b, c, d: True), ("a + c = 2 AND d > 0", lambda a, b, c, d: a + c == 2 and d > 0)):
        cells = {x: weight(x[0], x[1], 0) * weight(x[1], x[2], 1) * weight(x[2], x[3], 2) * weight(x[0], x[3], 3) for x in product_of(range(3), repeat=4) if holds(*x)}
        total = sum(cells.values())
        n = 20_000
        got = {tuple(r)[:4]: r["n"] for r in sample(model, spark, n, condition, seed=2).groupBy(*"abcd").agg(F.count("*").alias("n")).collect()}
        assert set(got) <= set(cells) and sum(got.values()) == n
        chi = sum((got.get(x, 0) - n * w / total) ** 2 / (n * w / total) for x, w in cells.items())
        assert chi < len(cells) + 5 * (2 * len(cells)) ** 0.5


def test_model_size_decides_which_pairs_may_be_chosen(spark, rows):
    tables = lambda m: {f.scope for f in m.factors if len(f.scope) > 1}
    wide = aim(rows, META, None, 40.0, 1e-5, MODE, rounds=6)
    assert tables(wide) == {("x0", "x1"), ("x0", "x2"), ("x1", "x2")}
    tight = aim(rows, META, None, 40.0, 1e-5, MODE, rounds=4, max_model_size=8e-6 * 20)  # 9 + 10 cells, not 30
    assert tables(tight) == {("x0", "x1")}
    none = aim(rows, META, None, 40.0, 1e-5, MODE, rounds=4, max_model_size=8e-6 * 10)
    assert tables(none) == set() and sample(none, spark, 10, seed=1).count() == 10


def test_graphs():
    square = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    assert clique_cells(list("abcd"), square, dict.fromkeys("abcd", 10)) == 2000
    assert clique_cells(list("abcd"), square[:3], dict.fromkeys("abcd", 10)) == 300
    assert draw_order(list("abcd"), [("a", "c"), ("c", "b")]) == ["a", "c", "b", "d"]


def test_wide_domains_fit(spark):
    """Ten columns of 300 codes, most of them rare: groups of rare codes keep the tables small, samples span all codes."""
    names = [f"c{k}" for k in range(10)]
    meta = TableMeta.from_dict({"rows": 3000, "columns": {c: {"type": "int", "precision": 32, "cardinality": 300, "categories": list(range(300))} for c in names}})
    code = F.when(F.col("id") % 3 > 0, F.col("id") % 5).otherwise(F.pmod(F.hash("id"), F.lit(300))).cast("int")
    wide = spark.range(3000).select(*[F.pmod(code + k, F.lit(300)).alias(c) for k, c in enumerate(names)])
    model = fit_mst(wide, meta, None, 8.0, 1e-5, MODE)
    assert len(model.factors) == 20 and max(f.table.count() for f in model.factors[:10]) < 2000
    out = sample(model, spark, 3000, seed=5)
    assert out.count() == 3000 and out.select("c0").distinct().count() > 100
    assert out.filter("pmod(c1 - c0, 300) = 1").count() > 1200


def test_single_column(spark, rows):
    for model in (fit_mst(rows, META, ["g"], 1.0, 1e-5, MODE), aim(rows, META, ["x"], 1.0, 1e-5, MODE)):
        assert sample(model, spark, 30, seed=1).count() == 30 and model.to_frame(spark).count() in (3, 10)


def test_refusals(rows):
    for bad in (
        lambda: check_request("pacsynth", 1.0, 1e-5), lambda: check_request("mst", 1.0, 1e-5, return_model=True), lambda: check_request("mwem", 1.0, 1e-5),
        lambda: check_request("aim", 1.0, None), lambda: check_request("aim", 1.0, 1.5), lambda: mwem(rows, META, None, 1.0, MODE, delta=1e-5),
        lambda: synth_encode(rows, META, ["g"], overrides={"x": Bins(0.0, 1.0)}), lambda: synth_encode(rows, META, ["x"], overrides={"x": Clamp(0.0, 1.0)}),
        lambda: synth_encode(rows, CUSTOMER, ["c_custkey"]), lambda: synth_encode(rows, META, ["nope"]),
    ):
        with pytest.raises(InvalidQuery):
            bad()
