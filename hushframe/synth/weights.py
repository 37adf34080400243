"""Multiplicative weights over the public cells (Hardt, Ligett, McSherry 2012), as a product of small component models."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.noise import Noise, Secure, Seeded, add_noise
from hushframe.metadata import TableMeta
from hushframe.operators.domain import domain_frame
from hushframe.operators.marginals import exact_marginals
from hushframe.session import written
from hushframe.synth.factors import Factor, FactorModel
from hushframe.synth.prepare import Encoded, check_request, synth_encode

PENDING = 8  # updates of single cells that are worked out anew from the stored weights


def mwem(df: DataFrame, meta: TableMeta, columns: list[str] | None, epsilon: float, mode: Secure | Seeded, iterations: int = 10,
         rows: int | None = None, nullable: bool = False, overrides: dict | None = None, delta: float | None = None,
         max_ids: int = 1, split_factor: int | None = None, measure_only: bool = False) -> FactorModel:
    """``split_factor`` columns form a component with its own cells and an equal part of epsilon; all of them by default.

    Per iteration and component, the worst-answered marginal cell by the exponential mechanism, measured with Laplace
    noise, and one multiplication of the component's stored weights.  With ``measure_only`` nothing is chosen: the
    marginals take turns, each is measured whole with the iteration's whole budget, and all its cells are updated.
    ``rows`` is the public table size (``meta.rows``).  Columns of different components are independent.
    """
    check_request("mwem", epsilon, delta)
    encoded = synth_encode(df, meta, columns, nullable, overrides)
    names = list(encoded.plan)
    split = len(names) if split_factor is None else split_factor
    if iterations < 1 or split < 1:
        raise InvalidQuery("mwem needs at least one iteration and one column in a component")
    var = {c: f"x{k}" for k, c in enumerate(names)}
    parts = [names[i:i + split] for i in range(0, len(names), split)]
    size = float(rows or meta.rows)
    factors = [component(encoded, part, var, epsilon / len(parts), size, iterations, mode, max_ids, measure_only) for part in parts]
    return FactorModel(encoded, factors, list(var.values()), var, {v: c for c, v in var.items()})


def component(encoded: Encoded, names: list[str], var: dict[str, str], epsilon: float, size: float, iterations: int,
              mode: Secure | Seeded, max_ids: int, measure_only: bool) -> Factor:
    """Weights over the cells of ``names``, stored after every few iterations: until then updates are a factor each."""
    spark, domains = encoded.codes.sparkSession, {c: encoded.domains[c] for c in names}
    sets = [(c,) for c in names] + list(combinations(names, 2))
    exact = written(exact_marginals(encoded.codes.select(*names), domains, sets).withColumn("n", F.col("n").cast("double")), "synth-exact")
    weights = domain_frame(spark, domains).withColumn("w", F.lit(1.0))
    share = epsilon / iterations if measure_only else epsilon / (2.0 * iterations)
    for step in range(iterations):
        turn = [sets[step % len(sets)]] if measure_only else sets
        grouped = weights.groupingSets([[F.col(c) for c in s] for s in turn], *names).agg(F.sum("w").alias("w"))
        answers = grouped.select(*[F.col(c).alias(f"__{c}") for c in names], "w")
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        # every marginal adds up to the whole weight
        whole = F.sum("w").over(Window.partitionBy("marginal"))
        joined = exact.filter(F.col("marginal").isin([",".join(s) for s in turn])).join(answers, same).withColumn("model", F.col("w") * F.lit(size) / whole)
        joined = joined.select("marginal", *names, "n", "model")
        if not measure_only:
            scored = joined.withColumn("gap", F.abs(F.col("n") - F.col("model")))
            noisy = add_noise(scored, [Noise("gap", "gumbel", 2.0 * max_ids / share)], ["marginal", *names], mode, f"mwem-pick{step}")
            joined = noisy.agg(F.max_by(F.struct("marginal", *names, "n", "model"), F.struct("gap", "marginal", *names)).alias("q")).select("q.*")
        measured = add_noise(joined, [Noise("n", "laplace", max_ids / share)], ["marginal", *names], mode, f"mwem-measure{step}")
        factor = measured.select(*[F.col(c).alias(f"__{c}") for c in names], F.exp((F.col("n") - F.col("model")) / F.lit(2.0 * size)).alias("__f"))
        if measure_only:
            weights = weights.join(factor.select(*[F.col(f"__{c}").alias(c) for c in turn[0]], "__f"), list(turn[0]))
            weights = weights.select(*names, (F.col("w") * F.col("__f")).alias("w"))
        else:
            cell, hit = factor.first(), F.lit(True)  # the one measured cell; columns outside its marginal are null
            for c in names:
                hit = hit if cell[f"__{c}"] is None else hit & (F.col(c) == F.lit(cell[f"__{c}"]))
            weights = weights.withColumn("w", F.when(hit, F.col("w") * F.lit(cell["__f"])).otherwise(F.col("w")))
        if measure_only or step % PENDING == PENDING - 1:
            weights = written(weights, "synth-weights")
    scope = tuple(var[c] for c in names)
    return Factor(scope, weights.select(*[F.col(c).cast("int").alias(var[c]) for c in names], "w"))
