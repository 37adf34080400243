"""Histograms, marginals and quantiles over public domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.literals import constant_array
from hushframe.functions.noise import Noise, Secure, Seeded, add_noise
from hushframe.functions.ranges import edge_position
from hushframe.operators.domain import clamped, complete, domain_frame, domain_size
from hushframe.plans.accounting import Cost

ALL = "__all__"

# Joint cells beyond which grouping sets expand rows and not cells; the result is the same.
JOINT_CELLS = 10_000_000


def bin_code(column: str | Column, lower: float, upper: float, bins: int) -> Column:
    """Equal-width bin 0 … bins-1 of the clamped value; the upper bound belongs to the last bin."""
    if not lower < upper or bins < 1:
        raise InvalidQuery("bins need lower < upper and at least one bin")
    share = (clamped(column, lower, upper).cast("double") - F.lit(float(lower))) / F.lit(float(upper - lower))
    return F.least(F.lit(bins - 1), F.floor(share * F.lit(float(bins))).cast("int"))


def private_histogram(df: DataFrame, column: str, lower: float, upper: float, epsilon: float, mode: Secure | Seeded,
                      bins: int = 10, max_ids: int = 1, tag: str = "histogram") -> DataFrame:
    """Noisy counts over public edges; a row falls in one bin, so the whole histogram costs epsilon."""
    counts = (
        df.select(bin_code(column, lower, upper, bins).alias("bin")).filter(F.col("bin").isNotNull())
        .groupBy("bin").agg(F.count("*").alias("n"))
    )
    full = complete(counts, {"bin": list(range(bins))}, ["n"])
    width = (upper - lower) / bins
    noisy = add_noise(full, [Noise("n", "laplace", max_ids / epsilon)], ["bin"], mode, tag)
    return noisy.select("bin", (F.lit(float(lower)) + F.col("bin") * F.lit(width)).alias("lower"),
                        (F.lit(float(lower)) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "n")


def margins(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts at every subset of the grouping columns; ``grouping`` tells totals from null keys.

    The finest grouping is aggregated first, so the cube expands groups and not rows.
    """
    finest = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    return finest.cube(*columns).agg(F.sum("__n").alias("n"), F.grouping_id().cast("bigint").alias("grouping"))


def exact_marginals(df: DataFrame, domains: dict[str, list], sets: list[tuple[str, ...]]) -> DataFrame:
    """Contingency tables of several column sets in one pass, zero cells included; private.

    Rows: ``marginal`` (the set's columns joined by a comma), every domain column (null when not in the
    set), ``n``.  Cells are counted once when the joint domain is small; the sets then regroup cells.
    """
    columns = list(domains)
    for s in sets:
        if not s or any(c not in domains for c in s):
            raise InvalidQuery(f"marginal {s} names a column without a public domain")
    known = df.select(*columns)
    for c in columns:
        known = known.filter(F.col(c).isin(*domains[c]))
    weight: Column = F.count("*")
    if domain_size(domains) <= JOINT_CELLS:
        known = known.groupBy(*columns).agg(F.count("*").alias("__w"))
        weight = F.sum("__w")
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    label = {sum(bit[c] for c in columns if c not in s): ",".join(s) for s in sets}
    name = F.create_map(*[x for k, v in label.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    counted = (
        known.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
        .agg(weight.alias("n"), F.grouping_id().cast("bigint").alias("__g"))
        .withColumn("marginal", name[F.col("__g")])
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = None
    for s in sets:
        frame = domain_frame(df.sparkSession, {c: domains[c] for c in s}, types)
        frame = frame.select(F.lit(",".join(s)).alias("marginal"),
                             *[F.col(c) if c in s else F.lit(None).cast(types[c]).alias(c) for c in columns])
        cells = frame if cells is None else cells.unionByName(frame)
    keyed = counted.select(F.col("marginal").alias("__m"), *[F.col(c).alias(f"__{c}") for c in columns], "n")
    same = F.col("marginal") == F.col("__m")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return cells.join(keyed, same, "left").select("marginal", *columns, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def private_marginals(df: DataFrame, domains: dict[str, list], sets: list[tuple[str, ...]], epsilon: float,
                      mode: Secure | Seeded, max_ids: int = 1, mechanism: str = "laplace", sigma: float | None = None,
                      tag: str = "marginals") -> DataFrame:
    """Noisy contingency tables; epsilon is shared evenly by the sets (or Gaussian with a given sigma)."""
    exact = exact_marginals(df, domains, sets)
    scale = sigma if mechanism == "gaussian" else max_ids * len(sets) / epsilon
    return add_noise(exact, [Noise("n", mechanism, scale)], ["marginal", *domains], mode, tag)


def private_quantile(df: DataFrame, column: str, candidates: list[float], alpha: float, temperature: float,
                     mode: Secure | Seeded, domains: dict[str, list] | None = None, name: str | None = None,
                     tag: str = "quantile") -> DataFrame:
    """Per group, the candidate chosen by the exponential mechanism for the ``alpha`` quantile.

    One pass counts rows per position among the sorted candidates; a running sum over those few positions
    gives the rows below and above every candidate.
    """
    if not 0 <= alpha <= 1 or not candidates:
        raise InvalidQuery("a quantile needs candidates and alpha in [0, 1]")
    domains = domains or {"__group": [0]}
    keys = list(domains)
    edges = sorted(set(candidates))
    source = df.withColumn("__group", F.lit(0)) if keys == ["__group"] else df
    counts = (
        source.select(*keys, edge_position(F.col(column), edges).alias("__at")).filter(F.col("__at").isNotNull())
        .groupBy(*keys, "__at").agg(F.count("*").alias("__n"))
    )
    full = complete(counts, {**domains, "__at": list(range(2 * len(edges) + 1))}, ["__n"])
    group = Window.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below, above = F.col("__upto") - F.col("__n"), F.col("__all") - F.col("__upto")
    score = -F.abs(F.lit(1.0 - alpha) * below - F.lit(float(alpha)) * above)
    label = name or "quantile"
    scored = (
        full.withColumns({"__upto": upto, "__all": F.sum("__n").over(group)})
        .filter(F.col("__at") % 2 == 1)
        .select(*keys, F.element_at(constant_array(edges), ((F.col("__at") + 1) / 2).cast("int")).alias(label),
                score.alias("__score"), ((F.col("__at") - 1) / 2).cast("int").alias("__c"))
    )
    return _noisy_best(scored, keys, label, temperature, mode, tag)


def _noisy_best(scored: DataFrame, keys: list[str], label: str, temperature: float, mode, tag: str) -> DataFrame:
    """Noisy maximum keyed by the candidate's index, since text of a double differs between engines."""
    pair = scored.withColumn("__pair", F.struct("__c", label)).drop(label)
    noisy = add_noise(pair, [Noise("__score", "gumbel", temperature, "__noisy")], [*keys, "__c"], mode, tag)
    best = F.max_by(F.col("__pair")[label], F.struct("__noisy", "__c")).alias(label)
    out = noisy.groupBy(*keys).agg(best)
    return out.drop("__group")


def quantile_cost(alpha: float, temperature: float, max_ids: int = 1) -> Cost:
    """Exponential mechanism: twice the score's sensitivity over the temperature."""
    return Cost(2.0 * max(alpha, 1.0 - alpha) * max_ids / temperature)
