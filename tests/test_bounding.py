import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hushframe.operators.bounding import bound_contributions, bound_partitions, keep_smallest
from hushframe.operators.prefix import chunk_edges, running_sums
from hushframe.operators.repeat import repeat_rows


def _hash(*keys):
    return hashlib.md5("|".join(["0", "bound", *map(str, keys), "0"]).encode()).hexdigest()


def test_limit_runs_below_the_shuffle(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    plan = bound_contributions(orders, "o_custkey", 5, ["o_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    assert "o_totalprice" not in plan


def test_bucket_cut_equals_ranking_with_a_hot_group(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r["g"]].append(r["id"])
    for n in (1, 7, 100, 1999, 5000):
        expected = {i for ids in groups.values() for i in sorted(ids, key=lambda i: _hash(i))[:n]}
        for limit in (0, 64):
            assert {r["id"] for r in keep_smallest(rows, ["g"], n, ["id"], map_side_limit=limit).collect()} == expected


def test_copies_share_a_hash(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    for n in (100, 900, 2000, 2500):
        kept = Counter(r["v"] for r in keep_smallest(rows, [], n, ["v"]).collect())
        flat = sorted([r["v"] for r in rows.collect()], key=lambda v: (_hash(v), v))[:n]
        assert kept == Counter(flat)


def test_groups_and_rows_per_unit(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 60).alias("u"), (F.col("id") * 13 % 7).alias("g"))
    kept = bound_partitions(rows, "u", ["g"], 3, 2, ["id"]).collect()
    per_pair, per_unit = Counter((r["u"], r["g"]) for r in kept), defaultdict(set)
    for r in kept:
        per_unit[r["u"]].add(r["g"])
    assert max(per_pair.values()) == 2 and {len(g) for g in per_unit.values()} == {3}


def test_running_sums_with_a_hot_key(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"),
                                    (F.col("id") % 11).alias("v"))
    edges = chunk_edges(rows, "id")
    assert len(edges) > 100
    out = {r["id"]: r["s"] for r in running_sums(rows, ["k"], ["id"], {"s": F.col("v")}, edges).collect()}
    totals = Counter()
    for r in sorted(rows.collect()):
        totals[r["k"]] += r["v"]
        assert out[r["id"]] == totals[r["k"]]


def test_repeat_rows_in_blocks(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2503)], "k string, n int")
    out = repeat_rows(rows, "n", block=100)
    assert Counter(r["k"] for r in out.collect()) == {"b": 1, "c": 2503}
    assert out.filter("k = 'c'").select("__copy").distinct().count() == 2503
