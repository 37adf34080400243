"""Hard-negative mining against brute force over all pairs, with ties, repeated rows and rows that take no part."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hushframe.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, row int, block int, `a.b` int"


def brute(rows, positives=5, negatives=10):
    sound = [(k, i, l, [math.floor(256 * x) for x in v]) for k, (i, v, l) in enumerate(rows)
             if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, l, v in sound:
        if i % 100:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        ranked = sorted((-score(w), j, m) for m, j, n, w in sound if n == l and m != k)[:positives]
        others = sorted((-score(w), j, m) for m, j, n, w in sound if n != l)
        for p, j, _ in ranked:
            inside = [x for x in others if 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 0, 0, 0) for i, v, l in rows], SCHEMA).repartition(4)


def mined(spark, rows, **options):
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def fixture(n=700, size=24):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 0.4) for _ in range(size)] for _ in range(4)]
    common = [rng.gauss(0, 0.4) for _ in range(size)]
    rows = []
    for i in range(n):
        label = rng.randrange(4)
        rows.append((i, [c + s + rng.gauss(0, 0.2) for c, s in zip(centres[label], common)], label))
    rows += [(k, [0.5] * size, k % 4) for k in range(800, 830)]  # ties in score
    rows += [(100, rows[100][1], rows[100][2]), (250, rows[100][1], rows[100][2]), (900, [-x for x in common], 2)]  # repeated ids and rows
    rows += [(None, [0.1] * size, 1), (1000, None, 1), (1100, [0.1] * size, None), (1200, [None] + [0.1] * (size - 1), 1), (1300, [math.nan] * size, 1),
             (1400, [math.inf] * size, 2), (1500, [0.0] * size, 3), (1600, [], 3), (1700, [1.0, 2.0], 0)]
    return rows


@pytest.mark.parametrize("block", [65_536, 50])
def test_against_all_pairs(spark, block):
    rows = fixture()
    assert mined(spark, rows, block=block) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-3e5, 3e5) for _ in range(6)], i % 3) for i in range(250)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e12, 1e12], 0), (1, [1e12, 1.0], 0)])


def test_few_and_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.95], 2)]
    assert mined(spark, rows) == brute(rows) == [(0, 1, 1, 2, 65536, 32768)]
