import math

import pytest
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.noise import Seeded
from hushframe.metadata import TableMeta
from hushframe.operators.aggregate import PrivateQuery, compose, private_agg
from hushframe.operators.measure import Measure
from hushframe.plans.accounting import gaussian_sigma, grouped_cost, pure_cost, zcdp_cost
from hushframe.plans.primitives import avg, count, std, sum_, var

MODE = Seeded(1, allow_insecure=True)
META = TableMeta.from_dict({"max_ids": 3, "rows": 100, "row_privacy": False, "columns": {
    "g": {"type": "string", "cardinality": 3, "categories": ["a", "b", "c"], "max_influenced_partitions": 2, "max_partition_contributions": 2},
    "x": {"type": "float", "precision": 64, "lower": -2.0, "upper": 10.0}, "k": {"type": "string"}}})
ONE = TableMeta.from_dict({"max_ids": 1, "rows": 100, "row_privacy": True, "columns": {k: c.to_dict() for k, c in META.columns.items()}})


def test_cost_facts():
    q = lambda *aggs, **o: PrivateQuery(ONE, aggs, 0.5, **o).cost().epsilon
    assert q(count()) == 0.5
    assert q(avg("x")) == 1.0
    assert q(std("x")) == 1.5 and q(var("x")) == 1.5
    assert q(count("x"), avg("x"), std("x")) == 1.5
    assert q(count(), by=("g",)) == 0.5
    two = 2 * grouped_cost(1, 0.1, 1e-5).delta
    assert math.isclose(0.005 - two, 0.0049700001, abs_tol=1e-12)


def test_gaussian_round_trip():
    sigma = gaussian_sigma(2.0, 1.7, 1e-6)
    assert math.isclose(zcdp_cost(2.0, sigma, 1e-6).epsilon, 1.7)
    assert pure_cost(3.0, 1.5).epsilon == 2.0


@pytest.mark.parametrize("bad", [
    dict(aggs=(), epsilon=1.0), dict(aggs=(count(),), epsilon=0.0), dict(aggs=(count(),), epsilon=1.0, delta=1.0),
    dict(aggs=(sum_("nope"),), epsilon=1.0), dict(aggs=(sum_("k"),), epsilon=1.0, by=("k",)), dict(aggs=(count(),), epsilon=1.0, by=("k",), censor=True),
    dict(aggs=(count(),), epsilon=1.0, mechanisms={"count": "gaussian"}), dict(aggs=(count(),), epsilon=1.0, mechanisms={"median": "laplace"}),
    dict(aggs=(count(),), epsilon=1.0, unit="u"),
])
def test_invalid_queries(spark, bad):
    with pytest.raises(InvalidQuery):
        q = PrivateQuery(ONE, **bad)
        q.noisy(spark.createDataFrame([("a", 1.0, "k")], "g string, x double, k string"), MODE)


def _rows(spark):
    return spark.range(600).select(
        F.col("id"), (F.col("id") % 40).alias("u"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") * 7 % 3 + 1).cast("int")).alias("g"),
        (F.col("id") % 17 - 3).cast("double").alias("x"), F.lit("z").alias("k"))


@pytest.mark.parametrize("unit", [3, 11, 39])
def test_neighbours_differ_by_at_most_the_sensitivity(spark, unit):
    rows = _rows(spark).cache()
    query = PrivateQuery(META, (count(), sum_("x"), std("x")), 1.0, by=("g",), unit="u", row_key=("id",))
    full = {r["g"]: r for r in query.exact(rows).collect()}
    less = {r["g"]: r for r in query.exact(rows.filter(F.col("u") != unit)).collect()}
    for p in query.primitives:
        change = sum(abs(full[g][p.name] - less[g][p.name]) for g in full)
        assert change <= query.sensitivity(p) + 1e-9
    assert query.rows_per_unit == 3


def test_public_keys_completed_and_unknown_keys_dropped(spark):
    rows = spark.createDataFrame([("a", 1.0, "k"), ("z", 2.0, "k")], "g string, x double, k string")
    out = private_agg(rows, ONE, [count().alias("n"), sum_("x").alias("s")], epsilon=1e9, by=["g"], noise=MODE).collect()
    assert {r["g"]: (round(r["n"]), round(r["s"])) for r in out} == {"a": (1, 1), "b": (0, 0), "c": (0, 0)}


def test_nulls_nan_and_bounds(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (100.0,), (-100.0,), (1.0,)], "x double")
    q = PrivateQuery(ONE, (count("x"), sum_("x")), 1.0)
    r = q.exact(rows).first()
    assert r["sum_x"] == 10.0 - 2.0 + 1.0


def test_censored_keys_hide_single_units(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1990, "big").otherwise(F.concat(F.lit("rare"), F.col("id"))).alias("k"))
    meta = TableMeta.from_dict({"max_ids": 1, "rows": 10, "columns": {"k": {"type": "string"}}, "censor_dims": True})
    keys = [r["k"] for r in private_agg(rows, meta, [count()], epsilon=1.0, delta=1e-9, by=["k"], noise=MODE).collect()]
    assert keys == ["big"]


def test_secure_release_is_stored_once(spark):
    rows = _rows(spark)
    out = private_agg(rows, ONE, [count().alias("n")], epsilon=1.0, by=["g"])
    assert sorted(out.collect()) == sorted(out.collect())
    again = private_agg(rows, ONE, [count().alias("n")], epsilon=1.0, by=["g"])
    assert sorted(out.collect()) != sorted(again.collect())


def test_release_path_is_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "release")
    private_agg(_rows(spark), ONE, [count()], epsilon=1.0, path=path)
    with pytest.raises(Exception):
        private_agg(_rows(spark), ONE, [count()], epsilon=1.0, path=path)


def test_composition_adds_costs_and_checks_shape(spark):
    a, b = PrivateQuery(ONE, (count(),), 0.5, by=("g",), tag="a"), PrivateQuery(ONE, (avg("x"),), 1.0, by=("g",), tag="b")
    assert compose([a, b]).cost().epsilon == 2.5
    assert compose([a, b]).noisy(_rows(spark), MODE).columns == ["g", "a_count_rows", "b_avg_x"]
    with pytest.raises(InvalidQuery):
        compose([a, PrivateQuery(ONE, (count(),), 1.0, tag="c")])
    with pytest.raises(InvalidQuery):
        compose([a, a])


def test_sum_does_not_depend_on_order(spark):
    rows = spark.range(50_000).select((F.sin("id") * 9).alias("x"))
    q = PrivateQuery(ONE, (sum_("x"),), 1.0)
    assert q.exact(rows).first() == q.exact(rows.repartition(23)).first()


def test_measure_rules(spark):
    m = Measure(_rows(spark), row_key=("id",)).column("x")
    for bad in (lambda: m.sum(), lambda: m.mean(), lambda: m.clamp(0, 5).resize(10, 9.0), lambda: m.laplace(1.0), lambda: m.count().laplace(0.0),
                lambda: m.count().cost(), lambda: m.count().gaussian(1.0).cost(), lambda: m.count().laplace_threshold(1.0, 2.0), lambda: m.column("q")):
        with pytest.raises(InvalidQuery):
            bad()
    sized = m.clamp(0.0, 35.0).resize(346, 10.0).variance().laplace(5.0)
    assert math.isclose(sized.cost().epsilon, 35.0**2 / 346 / 5.0)
    assert m.count().laplace(2.0).cost().epsilon == 0.5
    assert m.count().gaussian(2.0).cost(1e-6).delta == 1e-6


def test_resized_pads_and_truncates(spark):
    m = Measure(_rows(spark), row_key=("id",)).column("x").clamp(0.0, 10.0)
    for n in (1, 599, 600, 601, 2500):
        assert m.resize(n, 5.0).resized().count() == n


def test_averages_leave_nan_out_of_the_count(spark):
    meta = TableMeta.from_dict({"columns": {"x": {"type": "float", "precision": 64, "lower": 0.0, "upper": 10.0}}})
    rows = spark.createDataFrame([(8.0,)] * 500 + [(float("nan"),)] * 500 + [(None,)] * 7, "x double")
    exact = PrivateQuery(meta, (avg("x"), std("x")), 1.0).exact(rows).first()
    assert exact["count_x"] == 500 and exact["sum_x"] == 4000.0


def test_rows_that_are_no_units_need_a_unit(spark):
    columns = {"g": {"type": "string", "cardinality": 1, "categories": ["a"]}, "x": {"type": "int", "precision": 32, "lower": 0, "upper": 9}}
    with pytest.raises(InvalidQuery, match="name the unit"):
        PrivateQuery(TableMeta.from_dict({"max_ids": 4, "row_privacy": False, "columns": columns}), (count(),), 1.0)
    who = {"who": {"type": "int", "precision": 64, "lower": 0, "upper": 99, "private_id": True}}
    query = PrivateQuery(TableMeta.from_dict({"max_ids": 4, "row_privacy": False, "columns": {**columns, **who}}), (count(),), 1.0)
    rows = spark.createDataFrame([("a", 1, 7)] * 10 + [("a", 2, 8)] * 3, "g string, x int, who bigint")
    assert query.unit == "who" and query.exact(rows).first()["count_rows"] == 7


def test_declared_group_length_is_applied(spark):
    meta = TableMeta.from_dict({"columns": {"g": {"type": "string", "cardinality": 2, "categories": ["a", "b"], "max_partition_length": 5},
                                            "x": {"type": "float", "precision": 64, "lower": -3.0, "upper": 10.0}}})
    with pytest.raises(InvalidQuery, match="row_key"):
        PrivateQuery(meta, (count(),), 1.0, by=("g",))
    query = PrivateQuery(meta, (count(), sum_("x")), 1.0, by=("g",), row_key=("id",))
    rows = spark.createDataFrame([(i, "a", 1.0) for i in range(100)] + [(200, "b", 1.0)], "id int, g string, x double")
    assert {r["g"]: r["count_rows"] for r in query.exact(rows).collect()} == {"a": 5, "b": 1}
    assert [query.sensitivity(p) for p in query.primitives] == [1.0, 13.0]  # a row in, another out
