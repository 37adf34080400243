from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.transform import Anonymize, Bins, Clamp, DaysSince, Label, MinMax, decode, default_plan, encode
from hushframe.metadata import TableMeta
from hushframe.operators import clean as C
from hushframe.operators import post as P
from hushframe.operators.order_stats import exact_quantiles
from hushframe.sources.dummy import dummy, dummy_like
from hushframe.sources.tables import from_frame, read_private

META = TableMeta.from_dict({"columns": {
    "kind": {"type": "string", "cardinality": 3, "categories": ["x", "y", "z"]}, "letter": {"type": "string"},
    "flag": {"type": "boolean", "nullable": True}, "small": {"type": "float", "precision": 32, "lower": 10.0, "upper": 20.0},
    "big": {"type": "int", "precision": 64, "lower": 100, "upper": 120},
    "day": {"type": "datetime", "lower": "2000-01-01", "upper": "2010-01-01", "nullable": True}}})


def test_dummy_columns(spark):
    df = dummy(spark, META, 500).toPandas()
    assert [f.dataType for f in dummy(spark, META, 1).schema] == [f.dataType for f in META.to_struct()]
    assert set(df["kind"]) == {"x", "y", "z"} and df["letter"].str.len().eq(1).all() and df["letter"].nunique() > 50
    assert df["small"].between(10, 20).all() and set(df["big"]) == set(range(100, 121))
    assert 1 <= df["flag"].isna().sum() <= 5 and 1 <= df["day"].isna().sum() <= 5 and not df["kind"].isna().any()
    days = df["day"].dropna()
    assert days.between("2000-01-01", "2010-01-01").all() and (days.dt.normalize() == days).all()


def test_dummy_seed(spark):
    rows = lambda seed: dummy(spark, META, 50, seed).collect()
    assert rows(42) == rows(42) and rows(42) != rows(43)


def test_csv_by_header_name_and_bad_values(spark, tmp_path):
    meta = TableMeta.from_dict({"columns": {"a": {"type": "int", "precision": 32, "lower": 0, "upper": 9}, "t": {"type": "datetime", "lower": "2000-01-01", "upper": "2030-01-01"}}})
    good, bad, lacking = tmp_path / "good.csv", tmp_path / "bad.csv", tmp_path / "lacking.csv"
    good.write_text("other,t,a\nq,2020-05-01,3\n,,\n")
    bad.write_text("a,t\nthree,2020-05-01\n")
    lacking.write_text("a\n1\n")
    assert read_private(spark, meta, str(good)).collect() == [(3, datetime(2020, 5, 1)), (None, None)]
    with pytest.raises(Exception):
        read_private(spark, meta, str(bad)).collect()
    for uri in (str(lacking), "table.json"):
        with pytest.raises(InvalidQuery):
            read_private(spark, meta, uri)


def test_parquet_scan_is_pruned_and_filtered(spark, sf):
    meta = TableMeta.from_dict({"columns": {"l_quantity": {"type": "float", "precision": 64, "lower": 0, "upper": 50}, "l_returnflag": {"type": "string"}}})
    df = read_private(spark, meta, f"{sf}/lineitem.parquet").filter("l_quantity > 49").select("l_returnflag")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_computed_keys_stay_out_of_the_scan_filter(spark, sf):
    import gate.models as models
    plan = models._KM.step(spark.read.parquet(f"{sf}/lineitem.parquet"), models._KM.start(), 0, models.MODE)._jdf.queryExecution().executedPlan().toString()
    assert "array_position" not in "".join(line for line in plan.splitlines() if "Filter" in line)


def test_from_frame_needs_declared_columns(spark):
    with pytest.raises(InvalidQuery):
        from_frame(META, spark.range(3))


def test_long_category_lists_are_searched(spark):
    names = tuple(f"k{(7 * i) % 101}é" for i in range(101)) + ("k3é",)
    rows = spark.createDataFrame([(n,) for n in [*names, "", "zzz", "k", None]], "c string")
    got = rows.select("c", Label(names, True).encode(F.col("c")).alias("e")).collect()
    assert all(r.e == (102 if r.c is None else names.index(r.c) if r.c in names else None) for r in got)
    numbers = tuple(range(50, 0, -1))
    assert [r.e for r in spark.range(52).select(Label(numbers).encode(F.col("id").cast("int")).alias("e")).collect()] == [None, *range(49, -1, -1), None]


def test_nullable_min_max(spark):
    step = MinMax(0.0, 10.0, True)
    rows = spark.createDataFrame([(0.0,), (7.5,), (None,), (float("nan"),)], "x double").select(step.encode(F.col("x")).alias("e"))
    assert [r.e for r in rows.collect()] == [[-1.0, 0.0], [0.5, 0.0], [0.0, 1.0], [0.0, 1.0]]
    assert [r.x for r in rows.select(step.decode(F.col("e")).alias("x")).collect()] == [0.0, 7.5, None, None]


def test_exact_quantiles_with_a_hot_value(spark):
    rows = spark.range(9001).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.sin("id") * F.pow(F.lit(10.0), F.col("id") % 40 - 10)).alias("a"),
                                    F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"), F.lit(None).cast("double").alias("c"))
    probabilities = [0.0, 0.1, 0.5, 0.77, 1.0]
    found, pdf = exact_quantiles(rows, ["a", "b", "c"], probabilities), rows.toPandas()
    for c in ("a", "b"):
        assert np.allclose(found[c], np.quantile(pdf[c].dropna(), probabilities), rtol=1e-12)
    assert found["c"] == [None] * 5


def test_imputation(spark):
    rows = spark.createDataFrame([(1, 1.0, "b"), (2, float("nan"), "a"), (None, 4.0, None), (2, None, "b"), (1, 7.0, "a")], "i int, x double, s string")
    assert C.impute(rows, "drop").count() == 2
    assert [r["x"] for r in C.impute(rows, "mean").collect()] == [1.0, 4.0, 4.0, 4.0, 7.0]
    assert [r["s"] for r in C.impute(rows, "median").collect()] == ["b", "a", "a", "b", "a"]  # ties: the smallest
    assert [r["i"] for r in C.impute(rows, "most_frequent").collect()] == [1, 2, 1, 2, 1]
    assert C.impute(rows, "mean").schema == rows.schema
    with pytest.raises(InvalidQuery):
        C.impute(rows, "magic")


def test_release_checks(spark):
    C.check_release(spark.range(2))
    for bad in (spark.range(0), spark.createDataFrame([(None,)], "x double"), spark.createDataFrame([(float("nan"),)], "x double")):
        with pytest.raises(InvalidQuery):
            C.check_release(bad)
    with pytest.raises(InvalidQuery):
        C.select_cols(spark.range(1), ["id", "nope"])


def test_plans_round_trip(spark):
    cols = ["kind", "flag", "small", "big", "day"]
    rows = dummy(spark, META, 200).select(*cols)
    plan = default_plan(META, cols, "cube", nullable=True)
    codes = encode(rows, plan)
    assert codes.filter(" or ".join(f"{c} is null" for c in cols)).count() == 0
    back = decode(codes, plan, META)
    assert encode(back, plan).collect() == codes.collect() and back.dtypes == rows.dtypes
    gan = default_plan(META, cols, "gan")
    scaled = encode(rows, gan).toPandas()
    assert scaled["small"].between(-1, 1).all() and scaled["day"].dropna().between(-1, 1).all() and scaled["kind"].map(sum).eq(1).all()
    again = decode(encode(rows, gan), gan, META).toPandas()
    assert (again["kind"] == rows.toPandas()["kind"]).all()


def test_plan_rules():
    private = TableMeta.from_dict({"columns": {"u": {"type": "int", "precision": 64, "lower": 0, "upper": 9, "private_id": True}, "s": {"type": "string"}}})
    assert isinstance(default_plan(private, ["u"])["u"], Anonymize)
    for bad in (lambda: default_plan(private, ["s"]), lambda: default_plan(META, ["kind"], overrides={"big": Clamp(0, 1)}), lambda: default_plan(META, style="tall")):
        with pytest.raises(InvalidQuery):
            bad()


def test_decode_leaves_the_null_code_null(spark):
    codes = spark.range(4).select(F.col("id").cast("int").alias("c"))
    assert [r[0] for r in codes.select(Label(("a", "b", "c"), True).decode(F.col("c"))).collect()] == ["a", "b", "c", None]
    assert [r[0] for r in codes.select(Bins(0.0, 3.0, 3, True).decode(F.col("c"))).collect()] == [0.5, 1.5, 2.5, None]
    assert DaysSince(datetime(2000, 1, 1)).epoch.year == 2000


def test_split_is_disjoint_and_stable(spark):
    rows = spark.range(10_000)
    train, test = P.split(rows, ["id"], 0.25, 3)
    assert train.count() + test.count() == 10_000 and train.intersect(test).count() == 0 and abs(test.count() - 2500) < 200
    assert sorted(test.collect()) == sorted(P.split(rows.repartition(17), ["id"], 0.25, 3)[1].collect())
    for share in (0.0, 1.0):
        with pytest.raises(InvalidQuery):
            P.split(rows, ["id"], share)


def test_t_test_against_textbook(spark):
    release = spark.createDataFrame([("a", 10.0, 2.0, 12.0), ("b", 12.0, 3.0, 15.0), ("c", 9.0, 1.0, 30.0)], "g string, m double, s double, n double")
    out = {(r["group_a"], r["group_b"]): r for r in P.t_tests(release, "g", ["a", "b", "c"], "m", "s", "n", critical=2.0).collect()}
    pooled = (11 * 4 + 14 * 9) / 25
    assert abs(out[("a", "b")]["t"] - (-2 / (pooled * (1 / 12 + 1 / 15)) ** 0.5)) < 1e-12
    assert len(out) == 3 and out[("b", "c")]["significant"]


def test_dummy_like_has_the_rows_of_the_given_keys(spark):
    whole = {r.id: r for r in dummy(spark, META, 50, 7, keep_id=True).collect()}
    got = dummy_like(spark.range(50).filter("id % 3 = 0").withColumnRenamed("id", "k"), "k", META, 7, 50).collect()
    assert {r.id: r for r in got} == {i: r for i, r in whole.items() if i % 3 == 0}
