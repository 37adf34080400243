"""Spanning-tree synthesizer (McKenna et al. 2021): noisy one-way tables, a tree by noisy dependence, noisy tables on its edges."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.noise import Secure, Seeded
from hushframe.metadata import TableMeta
from hushframe.session import written
from hushframe.synth.counts import counted, distances, measured, one_way_cells, pick, rho_of, share, two_way_cells
from hushframe.synth.factors import Factor, FactorModel, sample
from hushframe.synth.prepare import DEFAULT_SAMPLES, check_request, synth_encode

RARE = -1  # the group of all codes of a column whose noisy count is below the noise
BELOW = 3.0  # in standard deviations


def component(edges: list[tuple[str, str]], start: str) -> set[str]:
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        fresh = {x for e in edges if at in e for x in e} - seen
        seen |= fresh
        todo += fresh
    return seen


def spanning_tree(columns: list[str], scores: dict[tuple[str, str], float], temperature: float, mode: Secure | Seeded) -> list[tuple[str, str]]:
    """Edge by edge, the noisily best pair that joins two parts."""
    edges: list[tuple[str, str]] = []
    while len(edges) < len(columns) - 1:
        open_ = {s: e for s, e in scores.items() if s[1] not in component(edges, s[0])}
        edges.append(pick(open_, temperature, mode, "mst-edge", len(edges)))
    return edges


def oriented(columns: list[str], edges: list[tuple[str, str]]) -> dict[str, str]:
    """The parent of every column but the first."""
    parent, todo = {}, [columns[0]]
    while todo:
        at = todo.pop(0)
        for other in columns:
            if other not in parent and other != columns[0] and ((at, other) in edges or (other, at) in edges):
                parent[other] = at
                todo.append(other)
    return parent


def fit_mst(df: DataFrame, meta: TableMeta, columns: list[str] | None, epsilon: float, delta: float, mode: Secure | Seeded,
            nullable: bool = False, overrides: dict | None = None, max_ids: int = 1) -> FactorModel:
    """A third of the budget each for one-way tables, the tree and two-way tables.

    Codes whose noisy count is below three standard deviations are one group of their column in all that follows, so
    the two-way tables have no more cells than the data can fill; a sampled group is drawn apart again evenly.
    Tables stay on the cluster; the driver sees a total per column and a score per pair.
    """
    check_request("mst", epsilon, delta)
    encoded, spark = synth_encode(df, meta, columns, nullable, overrides), df.sparkSession
    names, rho = list(encoded.plan), rho_of(epsilon, delta) / 3.0
    d, pairs = len(names), list(combinations(names, 2))
    counts = counted(encoded, [*[(c,) for c in names], *pairs])
    sigma = max_ids * math.sqrt(d / (2.0 * rho))
    noisy = measured(counts.of(*[(c,) for c in names]), one_way_cells(spark, encoded.sizes).withColumn("j", F.lit(-1)), sigma, mode, "mst1")
    codes = written(noisy.select("marginal", "i", F.when(F.col("n") < BELOW * sigma, RARE).otherwise(F.col("i")).alias("g"), "n"), "synth-codes")
    groups = codes.groupBy("marginal", "g").agg(F.sum("n").alias("n"), F.count("*").alias("members"))
    about = {r["marginal"]: r for r in groups.groupBy("marginal").agg(F.sum(F.greatest("n", F.lit(0.0))).alias("total"), F.max("members").alias("members")).collect()}
    if all(r["members"] == 1 for r in about.values()):
        groups = codes.select("marginal", "g", "n")  # every code is a group
    whole = Window.partitionBy("marginal")
    positive = F.sum(F.greatest("n", F.lit(0.0))).over(whole)
    groups = groups.withColumn("p", share(F.col("n"), positive, F.count("*").over(whole)))
    total = sum(max(r["total"], 1.0) for r in about.values()) / d
    group, code = ({c: f"{kind}{k}" for k, c in enumerate(names)} for kind in "gx")
    merged = [c for c in names if about[c]["members"] > 1]
    apart = {c: codes.filter(F.col("marginal") == c).select(F.col("i").alias(code[c]), F.col("g").alias(group[c])) for c in merged}
    factors = [Factor((group[names[0]],), groups.filter(F.col("marginal") == names[0]).select(F.col("g").alias(group[names[0]]), F.col("p").alias("w")), group[names[0]])]
    if d > 1:
        regrouped = regroup(counts.of(*pairs), codes) if merged else counts.of(*pairs)
        edges = spanning_tree(names, scored(regrouped, groups, pairs, total), 2.0 * max_ids / math.sqrt(8.0 * rho / (d - 1)), mode)
        sigma_two = max_ids * math.sqrt((d - 1) / (2.0 * rho))
        cells = two_way_cells(groups.select("marginal", F.col("g").alias("i")), edges)
        tables = written(measured(regrouped.filter(F.col("marginal").isin([",".join(e) for e in edges])), cells, sigma_two, mode, "mst2"), "synth-pairs")
        for child, parent in oriented(names, edges).items():
            factors.append(conditional(tables, groups, child, parent, edges, group))
    for c in merged:
        size = F.count("*").over(Window.partitionBy(group[c]))
        factors.append(Factor((code[c], group[c]), apart[c].withColumn("w", F.lit(1.0) / size), code[c]))
    return FactorModel(encoded, factors, [*group.values(), *[code[c] for c in merged]], {c: code[c] if c in merged else group[c] for c in names},
                       {**{group[c]: f"{c}~" for c in names}, **{code[c]: c for c in merged}}, {code[c]: group[c] for c in merged})


def regroup(counts: DataFrame, codes: DataFrame) -> DataFrame:
    """Two-way counts by groups of codes in place of codes."""
    side = codes.select(F.col("marginal").alias("__c"), F.col("i").alias("__i"), "g")
    name = F.split("marginal", ",")
    for at, c in (("i", 0), ("j", 1)):
        counts = counts.withColumn("__at", name[c]).join(side, (F.col("__at") == F.col("__c")) & (F.col(at) == F.col("__i")))
        counts = counts.drop(at, "__at", "__c", "__i").withColumnRenamed("g", at)
    return written(counts.groupBy("marginal", "i", "j").agg(F.sum("n").alias("n")), "synth-regrouped")


def scored(counts: DataFrame, groups: DataFrame, pairs: list[tuple[str, str]], total: float) -> dict[tuple[str, str], float]:
    """How far each pair is from independence, in rows."""
    name, side = F.split("marginal", ","), groups.select(F.col("marginal").alias("__c"), F.col("g").alias("__g"), "p")
    model = counts.select("marginal", "i", "j").withColumn("m", F.lit(total))
    for at, c in (("i", 0), ("j", 1)):
        model = model.withColumn("__at", name[c]).join(side, (F.col("__at") == F.col("__c")) & (F.col(at) == F.col("__g")))
        model = model.select("marginal", "i", "j", (F.col("m") * F.col("p")).alias("m"))
    found = distances(counts, model, total)
    return {s: found.get(",".join(s), total) for s in pairs}


def conditional(tables: DataFrame, groups: DataFrame, child: str, parent: str, edges: list[tuple[str, str]], group: dict[str, str]) -> Factor:
    """Shares of the child's groups given the parent's; its one-way shares where the parent's group has no positive cell."""
    straight = (parent, child) in edges
    pair, (x, y) = (parent, child) if straight else (child, parent), ("i", "j") if straight else ("j", "i")
    cells = tables.filter(F.col("marginal") == ",".join(pair)).select(F.col(x).alias(group[parent]), F.col(y).alias(group[child]), F.greatest("n", F.lit(0.0)).alias("n"))
    alone = groups.filter(F.col("marginal") == child).select(F.col("g").alias("__g"), "p")
    rows = cells.join(alone, F.col(group[child]) == F.col("__g"))
    total = F.sum("n").over(Window.partitionBy(group[parent]))
    weight = F.when(total > 0, F.col("n") / total).otherwise(F.col("p"))
    return Factor((group[parent], group[child]), rows.withColumn("w", weight).select(group[parent], group[child], "w"), group[child])


def mst(df: DataFrame, meta: TableMeta, columns: list[str] | None, epsilon: float, delta: float, mode: Secure | Seeded,
        n: int = DEFAULT_SAMPLES, condition: str | list[str] | None = None, seed: int | None = None, **options) -> DataFrame:
    """Samples only: this synthesizer's model is not handed out."""
    return sample(fit_mst(df, meta, columns, epsilon, delta, mode, **options), df.sparkSession, n, condition, seed)
