"""Exact quantiles in two scans, without sorting the table or holding its values in one buffer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.ranges import edge_position
from hushframe.operators.prefix import running_sums

ACCURACY = 10_000  # a sketched quantile is off by at most this part of the ranks
NEAR, FAR = 3.0 / ACCURACY, 0.05  # how far around a wanted share it is bracketed, in large and in small tables
IN_ORDER = 1_000_000  # distinct values inside brackets that are put in order without more ado
CUTS = 64  # pieces of a bracket whose values are summed up apart beyond that


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several numeric columns; None for a column without values.

    The first scan sketches ranks: every wanted rank lies between two sketched values.  The second counts the values
    between the brackets and each value inside one, added up before anything is shuffled.  Only what lies inside a
    bracket, a few ten-thousandths of the rows, is put in order, in pieces.  The driver sees the brackets and the
    values found.
    """
    values = [F.when(~F.isnan(v), v) for v in (F.col(c).cast("double") for c in columns)]
    shares = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-FAR, -NEAR, NEAR, FAR)})
    stats = [f for i, v in enumerate(values) for f in (
        F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.percentile_approx(v, shares, ACCURACY).alias(f"q{i}"))]
    head = df.agg(*stats).first()
    ranks = {i: sorted({r for p in probabilities for at in [p * (head[f"n{i}"] - 1)] for r in (math.floor(at), math.ceil(at))}) for i in range(len(columns)) if head[f"n{i}"]}

    def bracket(i: int, p: float) -> tuple[float, float]:
        n, sketched = head[f"n{i}"], dict(zip(shares, head[f"q{i}"]))
        reach = next((d for d in (NEAR, FAR) if n * d >= 3), None)
        if reach is None:
            return head[f"lo{i}"], head[f"hi{i}"]
        low, high = p - reach, p + reach
        return (sketched[low] if low > 0 else head[f"lo{i}"]), (sketched[high] if high < 1 else head[f"hi{i}"])

    brackets = {i: _disjoint([bracket(i, p) for p in probabilities]) for i in ranks}
    found: dict[int, dict[int, float]] = {i: {} for i in ranks}
    open_ = dict(brackets)
    while open_:
        for (i, rank), value in _ranked(df, {i: values[i] for i in open_}, open_, {i: ranks[i] for i in open_}).items():
            found[i][rank] = value
        # a sketch that missed a rank would leave it out: the whole range holds it
        open_ = {i: [(head[f"lo{i}"], head[f"hi{i}"])] for i in open_ if any(r not in found[i] for r in ranks[i])}

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for p in probabilities:
            at = p * ((head[f"n{i}"] or 0) - 1)
            if i not in ranks:
                out[c].append(None)
            else:
                low, high = found[i][math.floor(at)], found[i][math.ceil(at)]
                out[c].append(low + (high - low) * (at - math.floor(at)))
    return out


def _disjoint(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _ranked(df: DataFrame, values: dict[int, Column], brackets: dict[int, list[tuple[float, float]]], ranks: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """Values of those ranks, counted from zero, that lie inside the brackets of their column."""
    entries, spans = [], {}
    for i, v in values.items():
        edges = sorted({float(x) for s in brackets[i] for x in s})
        at = edge_position(v, edges)  # odd on an edge, even between two
        spans[i] = {p: s for s in brackets[i] for p in range(2 * edges.index(float(s[0])) + 1, 2 * edges.index(float(s[1])) + 2)}
        entries.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("c"), at.alias("k"), F.when(at.isin(sorted(spans[i])), v).alias("v"))))
    rows = df.select(entries[0].alias("e")) if len(entries) == 1 else df.select(F.explode(F.array(*entries)).alias("e"))
    counted = rows.filter("e is not null").groupBy("e.c", "e.k", "e.v").agg(F.count("*").alias("n")).persist()
    try:
        totals = counted.groupBy("c", "k").agg(F.sum("n").alias("n"), F.count("v").alias("distinct"), F.min("v").alias("only")).collect()
        wanted, found = [], {}
        for i in values:
            before = 0
            for r in sorted((r for r in totals if r["c"] == i), key=lambda r: r["k"]):
                start, before = before, before + r["n"]
                for rank in ranks[i]:
                    if start <= rank < before and r["k"] in spans[i]:
                        if r["distinct"] == 1:
                            found[(i, rank)] = r["only"]
                        else:
                            wanted.append((i, r["k"], rank, rank - start))
        if wanted:
            inside = counted.filter(F.col("v").isNotNull()).select("c", "k", "v", "n")
            if sum(r["distinct"] for r in totals) <= IN_ORDER:
                upto = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "k").orderBy("v")))
            else:
                marks = sorted({low + (high / CUTS - low / CUTS) * x for low, high in {spans[i][k] for i, k, _, _ in wanted} for x in range(1, CUTS)})
                upto = running_sums(inside, ["c", "k"], ["v"], {"upto": F.col("n")}, marks)
            here = [(F.col("c") == i) & (F.col("k") == k) & (F.col("upto") - F.col("n") <= at) & (F.lit(at) < F.col("upto")) for i, k, _, at in wanted]
            row = upto.agg(*[F.max(F.when(h, F.col("v"))).alias(f"r{x}") for x, h in enumerate(here)]).first()
            found.update({(i, rank): row[f"r{x}"] for x, (i, _, rank, _) in enumerate(wanted)})
        return found
    finally:
        counted.unpersist()
