"""Adaptive synthesizer (McKenna et al. 2022): marginals chosen by expected improvement, a model of cliques of bounded size."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.noise import Secure, Seeded
from hushframe.metadata import TableMeta
from hushframe.session import written
from hushframe.synth.counts import counted, distances, measured, one_way_cells, pick, rho_of, share, two_way_cells
from hushframe.synth.factors import Factor, FactorModel, clique_cells, marginal
from hushframe.synth.prepare import check_request, synth_encode

MODEL_SIZE = 80.0  # megabytes of cells, eight bytes each
ONE_WAY, SELECT = 0.2, 0.1  # parts of the budget: one-way tables; of the rest, choosing


def aim(df: DataFrame, meta: TableMeta, columns: list[str] | None, epsilon: float, delta: float, mode: Secure | Seeded,
        rounds: int | None = None, max_model_size: float = MODEL_SIZE, nullable: bool = False, overrides: dict | None = None,
        max_ids: int = 1) -> FactorModel:
    """A round asks which pair the model answers worst, beyond what measuring it would cost in noise, and measures it.

    A pair may be chosen if the model with it, triangulated, has cliques of ``max_model_size`` megabytes of cells at most;
    measuring a pair again averages it.  The model takes a measurement in by one step of proportional fitting: its
    weights times the measured over the modelled marginal, which is a factor over that pair.  At the end every
    measured pair is fitted once more.  All tables stay on the cluster; the driver sees a score per pair.
    """
    check_request("aim", epsilon, delta)
    encoded, spark = synth_encode(df, meta, columns, nullable, overrides), df.sparkSession
    names, rho = list(encoded.plan), rho_of(epsilon, delta)
    d, pairs = len(names), list(combinations(names, 2))
    var = {c: f"x{k}" for k, c in enumerate(names)}
    sizes, variables = {var[c]: k for c, k in encoded.sizes.items()}, list(var.values())
    counts = counted(encoded, [*[(c,) for c in names], *pairs])
    first = rho if d == 1 else ONE_WAY * rho
    codes = one_way_cells(spark, encoded.sizes)
    singles = measured(counts.of(*[(c,) for c in names]), codes.withColumn("j", F.lit(-1)), max_ids * math.sqrt(d / (2.0 * first)), mode, "aim1")
    whole = Window.partitionBy("marginal")
    total_of = F.sum(F.greatest("n", F.lit(0.0))).over(whole)
    singles = written(singles.withColumn("total", total_of).withColumn("p", share(F.col("n"), F.col("total"), F.count("*").over(whole))), "synth-singles")
    factors = {(var[c],): Factor((var[c],), singles.filter(F.col("marginal") == c).select(F.col("i").alias(var[c]), F.col("p").alias("w")), var[c]) for c in names}
    targets: dict[tuple[str, str], list[DataFrame]] = {}
    if d > 1:
        total = singles.groupBy("marginal").agg(F.max("total").alias("t")).agg(F.avg(F.greatest("t", F.lit(1.0)))).first()[0]
        rounds = rounds or max(1, 2 * (d - 1))
        select, spend = SELECT * (1.0 - ONE_WAY) * rho / rounds, (1.0 - SELECT) * (1.0 - ONE_WAY) * rho / rounds
        sigma, temperature = max_ids / math.sqrt(2.0 * spend), 2.0 * max_ids / math.sqrt(8.0 * select)
        expected = math.sqrt(2.0 / math.pi) * sigma
        for r in range(rounds):
            allowed = [s for s in pairs if s in targets or clique_cells(variables, [*[[var[c] for c in t] for t in targets], [var[c] for c in s]], sizes) * 8 <= max_model_size * 1e6]
            if not allowed:
                break
            errors = modelled_errors(counts.of(*allowed), factors, variables, allowed, var, total)
            best = pick({s: errors[s] - expected * encoded.sizes[s[0]] * encoded.sizes[s[1]] for s in allowed}, temperature, mode, "aim-pick", r)
            fresh = written(measured(counts.of(best), two_way_cells(codes, [best]), sigma, mode, f"aim2-{r}"), "synth-measured")
            targets.setdefault(best, []).append(fresh)
            fit(factors, variables, best, var, targets[best])
        for s in [s for s in pairs if s in targets] if len(targets) > 1 else []:
            fit(factors, variables, s, var, targets[s])
    return FactorModel(encoded, list(factors.values()), variables, var, {v: c for c, v in var.items()})


def modelled_errors(counts: DataFrame, factors: dict, variables: list[str], pairs: list[tuple[str, str]], var: dict[str, str], total: float) -> dict:
    """Per pair the distance between its exact and its modelled table, in rows."""
    model = None
    for a, b in pairs:
        name, keep = ",".join((a, b)), (var[a], var[b])
        one = counts.filter(F.col("marginal") == name).select("marginal", F.col("i").alias(keep[0]), F.col("j").alias(keep[1])).withColumn("m", F.lit(total))
        one = weighed(one, marginal(list(factors.values()), variables, keep), "m").select("marginal", F.col(keep[0]).alias("i"), F.col(keep[1]).alias("j"), "m")
        model = one if model is None else model.unionByName(one)
    found = distances(counts, model, total)
    return {s: found.get(",".join(s), total) for s in pairs}


def weighed(cells: DataFrame, parts: list[Factor], column: str) -> DataFrame:
    """``column`` times the weights of the factors at each cell; a cell that a factor does not have gets zero."""
    for f in parts:
        names = [F.col(v).alias(f"__{v}") for v in f.scope]
        same = [F.col(v) == F.col(f"__{v}") for v in f.scope]
        joined = cells.join(f.table.select(*names, F.col("w").alias("__w")), same, "left")
        cells = joined.withColumn(column, F.col(column) * F.coalesce("__w", F.lit(0.0))).select(*cells.columns)
    return cells


def fit(factors: dict, variables: list[str], pair: tuple[str, str], var: dict[str, str], tables: list[DataFrame]) -> None:
    """The model's marginal of ``pair`` becomes the mean of its measurements, negative cells as zero."""
    scope = (var[pair[0]], var[pair[1]])
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    target = every.groupBy("i", "j").agg(F.avg("n").alias("n")).select(F.col("i").alias(scope[0]), F.col("j").alias(scope[1]), F.greatest("n", F.lit(0.0)).alias("n"))
    target = target.withColumn("t", share(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0))), F.count("*").over(Window.partitionBy(F.lit(0)))))
    rows = weighed(target.withColumn("m", F.lit(1.0)), marginal(list(factors.values()), variables, scope), "m")
    rows = rows.filter("t > 0 and m > 0").select(*scope, (F.col("t") / F.col("m")).alias("w"))
    if scope in factors:
        rows = weighed(rows, [factors[scope]], "w")
    factors[scope] = Factor(scope, written(rows, "synth-factor"))
