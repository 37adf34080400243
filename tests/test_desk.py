import math

import pytest
from pyspark.sql import functions as F

from gate.core import CUSTOMER, SEGMENTS
from hushframe.desk import AggregateRequest, MeasureRequest, ModelRequest, QueryDesk, SynthRequest
from hushframe.errors import AccessDenied, InternalFailure, InvalidQuery, LibraryFailure
from hushframe.metadata import TableMeta
from hushframe.ml.chain import DPPipeline
from hushframe.ml.groups import DPGaussianNB
from hushframe.operators.ledger import BUDGET_STRUCT, decode_archive
from hushframe.plans.primitives import avg, count

OTHER = TableMeta.from_dict({"columns": {"x": {"type": "float", "precision": 64, "lower": 0, "upper": 1}}})
COUNT = AggregateRequest((count().alias("n"),), {"epsilon": 0.1, "delta": 1e-5})


@pytest.fixture
def desk(spark, sf, tmp_path):
    held = lambda e: [("customers", e, 0.005, 0.0, 0.0)]
    users = spark.createDataFrame([("ana", True, held(10.0)), ("bo", False, held(10.0)), ("cy", True, held(0.25)), ("di", True, [])],
                                  f"user_name string, may_query boolean, datasets_list {BUDGET_STRUCT}")
    tables = {"customers": (CUSTOMER, lambda: spark.read.parquet(f"{sf}/customer.parquet")), "other": (OTHER, lambda: None)}
    return QueryDesk(spark, users, tables, str(tmp_path / "archive"))


def test_budget_and_archive(spark, desk):
    assert desk.remaining("ana", "customers") == (10.0, 0.005)
    assert desk.cost("ana", "customers", COUNT).epsilon == 0.1
    first = desk.query("ana", "customers", COUNT)
    assert first.columns == ["n"] and first.collect() == first.collect()
    desk.query("ana", "customers", COUNT)
    epsilon, delta = desk.remaining("ana", "customers")
    assert math.isclose(epsilon, 9.8) and math.isclose(delta, 0.0049700001, abs_tol=1e-12)
    assert desk.previous("ana", "customers").count() == 2
    assert decode_archive(desk.archive()).select("smartnoise_sql.dataset_name").distinct().collect() == [("customers",)]
    assert desk.latest().filter("user_name = 'ana'").first()["spent_epsilon"] == 0.1


def test_budget_runs_out_and_rehearsal_is_free(desk):
    desk.query("cy", "customers", COUNT)
    desk.query("cy", "customers", COUNT)
    with pytest.raises(InvalidQuery, match="budget"):
        desk.query("cy", "customers", COUNT)
    assert desk.rehearse("cy", "customers", COUNT).count() == 1
    assert desk.previous("cy", "customers").count() == 2


def test_two_desks_cannot_overspend(spark, sf, desk):
    """Both see the same budget; the slower one finds its number taken, decides again and is refused."""
    other = QueryDesk(spark, desk.users, desk.tables, desk.archive_path)
    request = AggregateRequest((count().alias("n"),), {"epsilon": 0.2, "delta": 1e-5})
    commit, seen = desk._log.commit, []

    def slow(rows, after):
        if not seen:
            seen.append(other.query("cy", "customers", request))  # in between, the other desk spends
        return commit(rows, after)

    desk._log.commit = slow
    with pytest.raises(InvalidQuery, match="budget"):
        desk.query("cy", "customers", request)
    assert len(seen) == 1 and desk.previous("cy", "customers").count() == 1
    assert math.isclose(other.remaining("cy", "customers")[0], 0.05)


def test_every_family(desk):
    by_segment = AggregateRequest((count().alias("n"), avg("c_acctbal")), {"epsilon": 0.5, "by": ("c_mktsegment",)})
    assert desk.query("ana", "customers", by_segment).count() == 5
    total = MeasureRequest(lambda m: m.column("c_acctbal").clamp(0, 5000).sum().laplace(5000.0))
    assert desk.cost("ana", "customers", total).epsilon == 1.0 and desk.query("ana", "customers", total).count() == 1
    bayes = ModelRequest(DPPipeline([DPGaussianNB(1.0, {"c_acctbal": (-1000.0, 10000.0)}, SEGMENTS)]), ("c_acctbal",), "c_mktsegment", ("c_custkey",), score_epsilon=0.5)
    assert desk.cost("ana", "customers", bayes).epsilon == 1.5
    assert "score_accuracy" in {r["name"] for r in desk.query("ana", "customers", bayes).collect()}
    synth = SynthRequest("mst", 1.0, 1e-4, ("c_acctbal", "c_mktsegment"), nb_samples=25)
    assert desk.query("ana", "customers", synth).count() == 25
    model = SynthRequest("mwem", 1.0, None, ("c_mktsegment",), params={"iterations": 2}, return_model=True)
    assert desk.query("ana", "customers", model).columns == ["factor", "columns", "codes", "weight"]
    assert math.isclose(desk.remaining("ana", "customers")[0], 10 - 1.5 - 1.0 - 1.5 - 2.0)
    assert set(desk.archive().select("dp_librairy").distinct().toPandas()["dp_librairy"]) == {"smartnoise_sql", "opendp", "diffprivlib", "smartnoise_synth"}


def test_refusals(desk):
    for user, dataset, kind in (("eve", "customers", AccessDenied), ("bo", "customers", AccessDenied), ("di", "customers", AccessDenied),
                                ("ana", "other", AccessDenied), ("ana", "nothing", InvalidQuery)):
        with pytest.raises(kind):
            desk.query(user, dataset, COUNT)
    with pytest.raises(InvalidQuery):
        desk.cost("ana", "customers", SynthRequest("mst", 1.0, 1e-5, return_model=True))
    with pytest.raises(InvalidQuery):
        desk.cost("ana", "customers", MeasureRequest(lambda m: m.column("c_acctbal").count()))
    with pytest.raises(LibraryFailure):
        desk.cost("ana", "customers", AggregateRequest((count(),), {"epsilon": 0.1, "surprise": 1}))


def test_a_unit_of_several_rows_pays_for_each(spark):
    many = TableMeta.from_dict({"max_ids": 3, "rows": 10, "columns": {k: c.to_dict() for k, c in CUSTOMER.columns.items()}})
    bayes = ModelRequest(DPPipeline([DPGaussianNB(1.0, {"c_acctbal": (-1000.0, 10000.0)}, SEGMENTS)]), ("c_acctbal",), "c_mktsegment", ("c_custkey",))
    assert bayes.cost(many, spark).epsilon == 3.0
    total = MeasureRequest(lambda m: m.column("c_acctbal").clamp(0, 5000).sum().laplace(5000.0))
    assert total.cost(many, spark).epsilon == 3.0
    assert AggregateRequest((count(),), {"epsilon": 0.5}).cost(many, spark).epsilon == 0.5


def test_a_failed_release_stays_paid_and_silent(spark, desk):
    desk.tables["customers"] = (CUSTOMER, lambda: spark.range(5).select(F.raise_error(F.lit("secret value")).cast("string").alias("c_mktsegment")))
    with pytest.raises(InternalFailure) as caught:
        desk.query("ana", "customers", AggregateRequest((count(),), {"epsilon": 0.1, "by": ("c_mktsegment",)}))
    assert "secret" not in str(caught.value)
    assert math.isclose(desk.remaining("ana", "customers")[0], 9.9)
