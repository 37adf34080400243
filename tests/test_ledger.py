import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gate import ledgers as G
from hushframe.errors import InvalidQuery
from hushframe.operators import ledger as L
from hushframe.plans.accounting import invalid_requests, price
from hushframe.streaming.admission import Admission, PartAdmission, admit_micro_batches, admit_stream
from hushframe.streaming.run import drain


def brute_force(rows, budgets):
    spent, admitted = {}, set()
    for r in sorted(rows, key=lambda r: r["request_id"]):
        key = (r["user_name"], r["dataset_name"])
        if key not in budgets:
            continue
        cost = tuple(Decimal(repr(r[c])) for c in ("cost_epsilon", "cost_delta"))
        new = tuple(a + b for a, b in zip(spent.get(key, (Decimal(0), Decimal(0))), cost))
        if all(n <= b for n, b in zip(new, budgets[key])):
            spent[key] = new
            admitted.add(r["request_id"])
    return admitted


def _case(spark, n, hot_share=3):
    """A third of all requests on one key; costs from tiny to larger than the budget."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("request_id"), F.when(i % hot_share == 0, "hot").otherwise(F.concat(F.lit("u"), i % 5)).alias("user_name"), F.lit("d").alias("dataset_name"),
        F.round(F.pow(F.lit(10.0), (i * 7919 % 1000) / 250.0 - 2), 2).alias("cost_epsilon"), F.round((i * 104729 % 997) / 1e8, 9).alias("cost_delta"))


@pytest.mark.parametrize("epsilon, delta", [(60.0, 0.01), (400.0, 0.0002), (0.05, 0.01)])
def test_hot_and_cold_admission_equal_brute_force(spark, epsilon, delta):
    requests = _case(spark, 1500).cache()
    names = ["hot", *[f"u{k}" for k in range(4)]]  # u4 holds no budget
    budgets = spark.createDataFrame([(u, "d", epsilon, delta) for u in names], "user_name string, dataset_name string, epsilon double, delta double")
    expected = brute_force(requests.collect(), {(u, "d"): (Decimal(repr(epsilon)), Decimal(repr(delta))) for u in names})
    for hot in (10**9, 250):
        out = L.admit(requests, budgets, hot).collect()
        assert len(out) == 1500 and {r["request_id"] for r in out if r["admitted"]} == expected


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    requests = _case(spark, 900).cache()
    budgets = spark.createDataFrame([(u, "d", 60.0, 0.01) for u in ("hot", "u0", "u1", "u2")], "user_name string, dataset_name string, epsilon double, delta double")
    source = str(tmp_path / "requests")
    for part in range(3):  # files in request order
        requests.filter(f"request_id >= {300 * part} and request_id < {300 * part + 300}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batch = {r["request_id"]: r["admitted"] for r in L.admit(requests, budgets).collect()}
    assert {r["request_id"]: r["admitted"] for r in drain(admit_stream(stream, budgets)).collect()} == batch
    path = str(tmp_path / "settled")
    admit_micro_batches(stream, budgets, path, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    settled = spark.read.parquet(f"{path}/decisions")
    assert settled.select("batch").distinct().count() == 3
    assert {r["request_id"]: r["admitted"] for r in settled.collect()} == batch


@pytest.mark.parametrize("hot", [10**9, 3])
def test_tiny_costs_are_not_free(spark, hot):
    requests = spark.createDataFrame([(i, "u", "d", 4e-18, 4e-16) for i in range(10)] + [(20, "v", "d", 1e-300, 1e-300)], "request_id bigint, user_name string, dataset_name string, cost_epsilon double, cost_delta double")
    budgets = spark.createDataFrame([("u", "d", 1.0, 1e-15), ("v", "d", 1.0, 0.0)], "user_name string, dataset_name string, epsilon double, delta double")
    assert sorted(r.request_id for r in L.admit(requests, budgets, hot).collect() if r.admitted) == [0, 1]


def test_running_sums_split_equal_order_values(spark):
    from hushframe.operators import prefix

    rows = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.lit(5).alias("ts"), F.col("id"), (F.col("id") % 13).cast("decimal(36,20)").alias("x"))
    edges = prefix.order_edges(rows, ["ts", "id"])
    chunks = rows.filter("k = 'hot'").groupBy(prefix.chunk_of(["ts", "id"], edges)).count().collect()
    assert max(c["count"] for c in chunks) < 2700 / 50
    total, expected = {}, {}
    for r in rows.orderBy("id").collect():
        total[r.k] = total.get(r.k, 0) + r.x
        expected[r.id] = total[r.k]
    assert {r.id: r.s for r in prefix.running_sums(rows, ["k"], ["ts", "id"], {"s": F.col("x")}).collect()} == expected


def test_late_request_fails_the_stream(spark, tmp_path):
    requests, source = _case(spark, 60), str(tmp_path / "late")
    budgets = spark.createDataFrame([("hot", "d", 60.0, 0.01)], "user_name string, dataset_name string, epsilon double, delta double")
    for part in ("request_id >= 30", "request_id < 30"):
        requests.filter(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(Exception, match="arrived after request"):
        drain(admit_stream(stream, budgets))


def test_one_key_with_most_of_a_large_batch(spark, tmp_path):
    requests = _case(spark, 24_000).withColumn("user_name", F.when(F.col("request_id") % 10 > 0, "hot").otherwise("u1")).cache()
    budgets = spark.createDataFrame([(u, "d", 4000.0, 1.0) for u in ("hot", "u1")], "user_name string, dataset_name string, epsilon double, delta double")
    source = str(tmp_path / "hot")
    requests.orderBy(F.hash("request_id")).coalesce(1).write.parquet(source)  # one micro-batch in no order: slices overlap
    stream = spark.readStream.schema(requests.schema).parquet(source)
    got = {r["request_id"]: r["admitted"] for r in drain(admit_stream(stream, budgets)).collect()}
    assert got == {r["request_id"]: r["admitted"] for r in L.admit(requests, budgets).collect()} and 0 < sum(got.values()) < len(got)


class _Map(dict):
    updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_a_key_is_taken_in_slices():
    """Pieces of bounded size come out in order, whatever the number of slices; what waits is in the state, and gone at the end."""
    import random

    import pandas as pd

    def slices(n, size=2000):
        ids = list(range(n * size))
        random.Random(1).shuffle(ids)
        for k in range(n):
            part = ids[k * size:(k + 1) * size]
            yield pd.DataFrame({"user_name": "u", "dataset_name": "d", "request_id": part, "cost_epsilon": 1.0, "cost_delta": 0.0,
                                "e": [Decimal(1)] * size, "d": [Decimal(0)] * size, "be": [Decimal(150)] * size, "bd": [Decimal(1)] * size})

    def settle(n):
        admission = Admission(slice=500)
        admission.spent, admission.waiting = _Value(), _Map()
        waited, store = [0], admission._store

        def counted(run, part):
            count = store(run, part)
            waited[0] = max(waited[0], len(admission.waiting))
            return count

        admission._store = counted
        ids, admitted, largest = -1, 0, 0
        for out in admission.handleInputRows(("u", "d"), slices(n), None):
            assert out["request_id"].iloc[0] == ids + 1 and out["request_id"].is_monotonic_increasing
            ids, admitted, largest = int(out["request_id"].iloc[-1]), admitted + int(out["admitted"].sum()), max(largest, len(out))
        assert ids == n * 2000 - 1 and admitted == 150 and largest <= 500 and not admission.waiting and (n == 1 or waited[0] >= n)
        assert admission.spent.get() == ("150", "0", ids)

    for n in (1, 2, 20):
        settle(n)


def test_keys_of_a_part_share_calls_and_state(spark, tmp_path, monkeypatch):
    """Many keys take no more calls than there are parts, over micro-batches too; a late request of any of them still fails."""
    from hushframe.streaming import admission as A

    monkeypatch.setattr(A, "PARTS", 3)
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counted(PartAdmission):
        def handleInputRows(self, key, rows, timerValues):
            (calls / uuid.uuid4().hex).touch()
            yield from PartAdmission.handleInputRows(self, key, rows, timerValues)

    monkeypatch.setattr(A, "PartAdmission", Counted)
    i = F.col("id")
    requests = spark.range(1200).select(i.alias("request_id"), F.concat(F.lit("u"), i % 100).alias("user_name"), F.concat(F.lit("d"), i % 3).alias("dataset_name"),
                                        ((i % 7) / 2).alias("cost_epsilon"), F.lit(1e-5).alias("cost_delta"))
    budgets = requests.filter("user_name <> 'u7'").select("user_name", "dataset_name", F.lit(5.0).alias("epsilon"), F.lit(1.0).alias("delta")).distinct()
    source = str(tmp_path / "many")
    for k in range(2):
        requests.filter(F.col("request_id").between(600 * k, 600 * k + 599)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {r["request_id"]: r["admitted"] for r in drain(admit_stream(stream, budgets)).collect()}
    assert got == {r["request_id"]: r["admitted"] for r in L.admit(requests, budgets).collect()} and 0 < sum(got.values()) < len(got)
    assert 0 < len(list(calls.iterdir())) <= 6  # of 300 keys in two micro-batches


def test_a_late_request_of_one_key_in_a_part():
    import pandas as pd

    def rows(*asked):
        cost = {"cost_epsilon": 1.0, "cost_delta": 0.0, "e": Decimal(1), "d": Decimal(0), "be": Decimal(2), "bd": Decimal(1)}
        return iter([pd.DataFrame([{"user_name": u, "dataset_name": "d", "request_id": r, **cost} for u, r in asked])])

    admission = PartAdmission()
    admission.spent, admission.waiting = _Value(), _Map()
    settle = lambda *asked: [a for out in admission.handleInputRows((0,), rows(*asked), None) for a in out["admitted"]]
    assert settle(("a", 5), ("b", 1), ("a", 6), ("a", 7)) == [True, True, True, False]
    assert settle(("b", 3), ("b", 2), ("c", 1)) == [True, True, False]  # in request order: c, b, b
    with pytest.raises(Exception, match="arrived after request 7"):
        settle(("a", 7))


def test_prices(spark):
    rows = [
        (1, "sql", 0.5, 1e-5, [("count", None), ("avg", "x"), ("std", "x")], None, None, None, None, None, None, None),
        (2, "measurement", None, None, None, None, "max_divergence", "dataset", 3.0, 1.5, None, None),
        (3, "measurement", None, None, None, None, "zero_concentrated", "dataset", 1.0, 1.0, 1e-6, None),
        (4, "ml", None, None, None, [("a", 0.5), ("b", 1.0)], None, None, None, None, None, None),
        (5, "synth", 1.0, 0.0, None, None, None, None, None, None, None, "mwem"),
        (6, "measurement", None, None, None, None, None, "dataset", 1.0, 1.0, None, None),
        (7, "measurement", None, None, None, None, "zero_concentrated", "dataset", 1.0, 1.0, None, None),
        (8, "synth", 1.0, 1e-5, None, None, None, None, None, None, None, "mwem"),
    ]
    from hushframe.plans.accounting import REQUEST_SCHEMA
    requests = spark.createDataFrame(rows, REQUEST_SCHEMA)
    cost = {r["request_id"]: (r["cost_epsilon"], r["cost_delta"]) for r in price(requests).collect()}
    assert cost[1][0] == 2.0  # count of rows, and count, sum, squares of x
    assert cost[2] == (2.0, 0.0) and cost[4] == (1.5, 0.0) and cost[5] == (1.0, 0.0)
    assert abs(cost[3][0] - (0.5 + 2 * (0.5 * 13.815510557964274) ** 0.5)) < 1e-9 and cost[3][1] == 1e-6
    assert {k for k, v in cost.items() if v == (None, None)} == {6, 7, 8}
    reasons = {r["request_id"]: r["reason"] for r in invalid_requests(requests).collect()}
    assert reasons == {6: "not a measurement", 7: "fixed delta required", 8: "mwem takes no delta"}


def test_require_budget(spark, sf):
    left = spark.createDataFrame([("u", "d", 1.0, 1e-3)], "user_name string, dataset_name string, remaining_epsilon double, remaining_delta double")
    L.require_budget(left, "u", "d", 1.0, 1e-3)
    for args in (("u", "d", 1.1, 0.0), ("u", "d", 0.1, 2e-3), ("v", "d", 0.1, 0.0)):
        with pytest.raises(InvalidQuery):
            L.require_budget(left, *args)


def test_unknown_family_in_archive_fails(spark, sf):
    broken = G.archive(spark, sf).withColumn("dp_librairy", F.lit("other"))
    with pytest.raises(Exception, match="unknown request family"):
        L.decode_archive(broken).collect()
