import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.noise import WORDS, Noise, Secure, Seeded, add_noise, bit_chances, discrete_laplace_draws, select_noisy_max
from hushframe.functions.uniform import hex_mark, uniform, uniform_below, uniform_slot

LAWS = {  # mean, variance and median magnitude for scale 3
    "laplace": (0.0, 18.0, 3.0 * np.log(2)), "gaussian": (0.0, 9.0, 3.0 * 0.67449), "gumbel": (3.0 * 0.57722, np.pi**2 / 6 * 9.0, None),
    "discrete_laplace": (0.0, 17.83, None),
}


@pytest.mark.parametrize("mode", [Secure(), Seeded(3, allow_insecure=True)], ids=["secure", "seeded"])
@pytest.mark.parametrize("mechanism", LAWS)
def test_law(spark, mode, mechanism):
    n = 20_000 if mechanism == "discrete_laplace" and isinstance(mode, Secure) else 100_000
    rows = spark.range(n).withColumn("v", F.lit(0.0))
    x = add_noise(rows, [Noise("v", mechanism, 3.0)], ["id"], mode, "law").toPandas()["v"].to_numpy()
    mean, variance, median = LAWS[mechanism]
    assert abs(x.mean() - mean) < 5 * np.sqrt(variance / n)
    assert abs(x.var() / variance - 1) < 0.1
    if median:
        assert abs(np.median(np.abs(x)) / median - 1) < 0.05
    if mechanism == "discrete_laplace":
        assert (x == np.round(x)).all()


def test_draws_are_independent_across_rows_and_columns(spark):
    rows = spark.range(20_000).select("id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    x = add_noise(rows, [Noise("a", "laplace", 1.0), Noise("b", "laplace", 1.0)], ["id"], Seeded(1, allow_insecure=True), "t").toPandas()
    assert abs(np.corrcoef(x["a"], x["b"])[0, 1]) < 0.03
    assert abs(np.corrcoef(x["a"][:-1], x["a"][1:])[0, 1]) < 0.03


def test_seeded_is_stable_under_repartition_and_secure_is_not_repeatable(spark):
    rows = spark.range(100).withColumn("v", F.lit(0.0))

    def draw(df, mode):
        return {r["id"]: r["v"] for r in add_noise(df, [Noise("v", "laplace", 1.0)], ["id"], mode, "t").collect()}

    seeded = Seeded(5, allow_insecure=True)
    assert draw(rows, seeded) == draw(rows.repartition(13), seeded)
    assert draw(rows, seeded) != draw(rows, Seeded(6, allow_insecure=True))
    assert draw(rows, Secure()) != draw(rows, Secure())


def test_seeded_needs_consent_and_scales_are_checked():
    with pytest.raises(InvalidQuery):
        Seeded(1)
    with pytest.raises(InvalidQuery):
        Noise("v", "laplace", 0.0)
    with pytest.raises(InvalidQuery):
        Noise("v", "cauchy", 1.0)


def test_exponential_mechanism_frequencies(spark):
    rows = spark.range(20_000).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"))
    best = select_noisy_max(rows.withColumn("s", F.col("c").cast("double")), ["id"], "c", "s", 1.0, Secure())
    share = np.bincount(best.toPandas()["c"], minlength=3) / 20_000
    expected = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert np.abs(share - expected).max() < 0.02


def test_text_comparisons_equal_the_uniform(spark):
    u = uniform(4, "s", "id")
    rows = spark.range(5000).select(u.alias("u"), uniform_below(0.3, 4, "s", "id").alias("below"), uniform_slot(7, 4, "s", "id").alias("slot"))
    for r in rows.collect():
        assert r["below"] == (r["u"] < 0.3) and r["slot"] == int(r["u"] * 7)
    assert hex_mark(0.0) == "0" * 13


def test_small_discrete_scales_are_exact():
    import numpy as np

    from hushframe.functions.noise import secure_draws
    draws = secure_draws("discrete_laplace", np.array([1e-9] * 20 + [2.0] * 400))
    assert set(draws[:20]) == {0.0} and 1.5 < np.abs(draws[20:]).mean() < 2.6


def test_public_domains_have_no_cap(spark):
    from hushframe.operators.domain import domain_frame
    cells = domain_frame(spark, {f"c{i}": list(range(10)) for i in range(12)}, number="id")
    assert cells.rdd.getNumPartitions() == 100_000 and len(cells.columns) == 13  # generated lazily, far above what fits anywhere
    exact = domain_frame(spark, {"a": ["x", "y"], "b": list(range(3))}, number="id").orderBy("id").collect()
    assert [(r.a, r.b) for r in exact] == [(a, b) for a in "xy" for b in range(3)]


@pytest.mark.parametrize("scale", [0.3, 1.0, 2.5, 40.0])
def test_batched_discrete_noise_follows_its_law(scale):
    n, ratio = 400_000, math.exp(-1.0 / scale)
    draws = discrete_laplace_draws(scale, n)
    assert draws.dtype == np.int64
    reach = int(6 * scale) + 1
    law = np.array([(1 - ratio) / (1 + ratio) * ratio ** abs(x) for x in range(-reach, reach + 1)])
    seen = np.array([(draws == x).sum() for x in range(-reach, reach + 1)])
    law, seen = np.append(law, 1 - law.sum()) * n, np.append(seen, n - seen.sum())
    wide = law >= 5
    chi = ((seen - law)[wide] ** 2 / law[wide]).sum()
    assert chi < wide.sum() + 5 * math.sqrt(2 * wide.sum())


def test_digits_of_a_geometric_variable():
    """Chances of the digits multiply to the law, to far more places than a double has."""
    scale = Fraction(7, 3)
    chances = [sum(w << 64 * (WORDS - 1 - k) for k, w in enumerate(c)) / Fraction(2 ** (64 * WORDS)) for c in bit_chances(scale)]
    p = lambda x: math.prod(c if x >> j & 1 else 1 - c for j, c in enumerate(chances))
    for x in (0, 1, 5, 12, 40):
        assert abs(float(p(x + 1) / p(x)) - math.exp(-3 / 7)) < 1e-15
    assert abs(float(1 - sum(p(x) for x in range(300)))) < 1e-15
    with pytest.raises(InvalidQuery):
        bit_chances(Fraction(2**60))
