"""Discrete models as products of weight tables, conditioned and sampled exactly, cell tables on the cluster.

A model is a list of factors over integer variables.  Variables are drawn in an order in which the model's graph,
triangulated, needs no larger tables than its cliques: in reverse, each variable's factors are multiplied, the table is
kept and its sum over the variable goes on as a message; forward, each row draws the variable from its table, given
what it has drawn already.  So a condition on codes, being one more factor, is met exactly by every row, however rare.

Only the graph (a node per column) is planned on the driver.  A draw costs each row one join per variable.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations
from math import prod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.errors import LibraryFailure
from hushframe.functions.transform import decode
from hushframe.functions.uniform import uniform
from hushframe.operators.domain import domain_frame
from hushframe.session import written
from hushframe.synth.prepare import DEFAULT_SAMPLES, Encoded


@dataclass(frozen=True)
class Factor:
    """An int column per variable of ``scope`` and a weight ``w``; absent cells weigh nothing.

    ``given`` names a variable over which the weights add up to one for every choice of the others.
    """

    scope: tuple[str, ...]
    table: DataFrame
    given: str | None = None

    def times(self, other: Factor) -> Factor:
        shared = [v for v in self.scope if v in other.scope]
        scope = self.scope + tuple(v for v in other.scope if v not in shared)
        joined = self.table.join(other.table.withColumnRenamed("w", "__w"), shared)
        return Factor(scope, joined.select(*scope, (F.col("w") * F.col("__w")).alias("w")))

    def over(self, keep: Iterable[str]) -> Factor:
        """Weights summed over all variables that are not kept."""
        scope = tuple(v for v in self.scope if v in set(keep))
        return Factor(scope, self.table.groupBy(*scope).agg(F.sum("w").alias("w")))


# -- the graph -----------------------------------------------------------------------------------------------


def neighbours(variables: list[str], scopes: Iterable[Iterable[str]]) -> dict[str, set[str]]:
    near: dict[str, set[str]] = {v: set() for v in variables}
    for scope in scopes:
        for a, b in combinations(scope, 2):
            near[a].add(b)
            near[b].add(a)
    return near


def triangulated(variables: list[str], scopes: Iterable[Iterable[str]]) -> tuple[dict[str, set[str]], list[tuple[str, ...]]]:
    """The graph with the fewest edges added greedily so that it is chordal, and its cliques (not all maximal)."""
    near = neighbours(variables, scopes)
    left, cliques, full = {v: set(n) for v, n in near.items()}, [], {v: set(n) for v, n in near.items()}
    while left:
        missing = {v: [(a, b) for a, b in combinations(sorted(n), 2) if b not in left[a]] for v, n in left.items()}
        best = min(left, key=lambda v: (len(missing[v]), variables.index(v)))
        for a, b in missing[best]:
            for graph in (left, full):
                graph[a].add(b)
                graph[b].add(a)
        cliques.append(tuple(v for v in variables if v == best or v in left[best]))
        for other in left.pop(best):
            left[other].discard(best)
    return full, cliques


def clique_cells(variables: list[str], scopes: Iterable[Iterable[str]], sizes: dict[str, int]) -> int:
    """Cells of the maximal cliques of the triangulated graph: the size of a model."""
    cliques = [set(c) for c in triangulated(variables, scopes)[1]]
    return sum(prod(sizes[v] for v in c) for c in cliques if not any(c < d for d in cliques))


def draw_order(variables: list[str], scopes: Iterable[Iterable[str]]) -> list[str]:
    """Each next variable has the most drawn neighbours, ties by listing: in reverse it adds no edge to a chordal graph."""
    near, order = triangulated(variables, scopes)[0], []
    while len(order) < len(variables):
        order.append(max((v for v in variables if v not in order), key=lambda v: (len(near[v] & set(order)), -variables.index(v))))
    return order


# -- elimination ---------------------------------------------------------------------------------------------


def product(factors: list[Factor]) -> Factor:
    """Of factors that hang together by shared variables."""
    whole, left = factors[0], factors[1:]
    while left:
        following = next(f for f in left if set(f.scope) & set(whole.scope))
        whole = whole.times(following)
        left.remove(following)
    return whole


def eliminated(factors: list[Factor], order: Iterable[str], buckets: dict[str, Factor] | None = None) -> list[Factor]:
    """Sums the variables of ``order`` out, one after the other; ``buckets`` gets each one's table, stored."""
    pool = list(factors)
    for v in order:
        mine = [f for f in pool if v in f.scope]
        pool = [f for f in pool if v not in f.scope]
        whole = mine[0]
        if len(mine) > 1:
            whole = product(mine)
            if buckets is not None:
                whole = Factor(whole.scope, written(whole.table.filter("w > 0"), "synth-bucket"))
        if buckets is not None:
            buckets[v] = whole
        rest = [x for x in whole.scope if x != v]
        if rest and whole.given != v:  # a conditional alone sums to one
            pool.append(whole.over(rest))
    return pool


def marginal(factors: list[Factor], variables: list[str], keep: tuple[str, ...]) -> list[Factor]:
    """The model's weights over ``keep``: one factor per part of ``keep`` that hangs together."""
    near, reached, todo = neighbours(variables, [f.scope for f in factors]), set(keep), list(keep)
    while todo:
        fresh = near[todo.pop()] - reached
        reached |= fresh
        todo += fresh
    mine = [f for f in factors if set(f.scope) <= reached]
    order = [v for v in reversed(draw_order(variables, [*[f.scope for f in factors], keep])) if v in reached and v not in keep]
    parts, out = eliminated(mine, order), []
    while parts:
        group, rest = [parts[0]], parts[1:]
        while more := [f for f in rest if any(set(f.scope) & set(g.scope) for g in group)]:
            group += more
            rest = [f for f in rest if f not in more]
        parts = rest
        out.append(product(group))
    return out


# -- sampling ------------------------------------------------------------------------------------------------


def ladder(bucket: Factor, variable: str) -> DataFrame:
    """Per choice of the other variables the codes that weigh anything and their weights added up, as two lists."""
    rest = [v for v in bucket.scope if v != variable]
    keys = [F.col(v).cast("long").alias(f"__{v}") for v in rest] or [(F.col(variable) * 0).cast("long").alias("__one")]
    rows = bucket.table.filter("w > 0").select(*keys, F.col(variable).alias("code"), "w")
    names = [f"__{v}" for v in rest] or ["__one"]
    upto = F.sum("w").over(Window.partitionBy(*names).orderBy("code").rowsBetween(Window.unboundedPreceding, 0))
    steps = rows.withColumn("upto", upto).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("code", "upto"))).alias("steps"))
    return steps.select(*names, F.transform("steps", lambda s: s["code"]).alias("__codes"), F.transform("steps", lambda s: s["upto"]).alias("__upto"))


@dataclass
class FactorModel:
    """``names`` has the variable that holds each column's code, ``variables`` all of them in listing order.

    ``leaves`` are drawn last: each hangs from the one variable that it is mapped to.
    """

    encoded: Encoded
    factors: list[Factor]
    variables: list[str]
    names: dict[str, str]
    labels: dict[str, str]
    leaves: dict[str, str] = field(default_factory=dict)

    def draw_codes(self, spark: SparkSession, n: int, seed: int, first: int = 0, evidence: Iterable[Factor] = ()) -> DataFrame:
        factors, evidence = [*self.factors, *evidence], list(evidence)
        core = [v for v in self.variables if v not in self.leaves]
        order = draw_order(core, [{self.leaves.get(v, v) for v in f.scope} for f in factors]) + list(self.leaves)
        buckets: dict[str, Factor] = {}
        eliminated(factors, reversed(order), buckets)
        rows = spark.range(first, first + n)
        for v in order:
            rest, steps = [x for x in buckets[v].scope if x != v], ladder(buckets[v], v)
            if not rest and evidence and steps.isEmpty():
                raise LibraryFailure("no code of the model satisfies the condition")
            # one key on both sides, but no constant, which would make the join a product
            same = [(F.col(x).cast("long") == F.col(f"__{x}")) for x in rest] or [F.pmod("id", F.lit(1)) == F.col("__one")]
            rows = rows.join(steps, [*same]).withColumn("__u", uniform(seed, self.labels[v], "id") * F.element_at("__upto", -1))
            at = F.size(F.filter("__upto", lambda c: c <= F.col("__u")))
            rows = rows.select("id", *order[:order.index(v)], F.element_at("__codes", F.least(at + 1, F.size("__codes"))).cast("int").alias(v))
        return rows.select("id", *[F.col(self.names[c]).alias(c) for c in self.encoded.plan])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """All cells of all factors: which factor, its columns, the cell's codes and its weight."""
        out = None
        for k, f in enumerate(self.factors):
            one = f.table.select(F.lit(k).alias("factor"), F.lit(",".join(self.labels[v] for v in f.scope)).alias("columns"),
                                 F.array(*f.scope).alias("codes"), F.col("w").alias("weight"))
            out = one if out is None else out.unionByName(one)
        return out


def evidence_of(condition: str, model: FactorModel, spark: SparkSession) -> Factor | None:
    """The codes whose values satisfy a condition, over the columns that it reads; None if it reads none and holds."""
    columns, encoded = list(model.encoded.plan), model.encoded
    fields = decode(spark.createDataFrame([], ", ".join(f"`{c}` int" for c in columns)), encoded.plan, encoded.meta).schema.fields

    def holds(kept: list[str]) -> DataFrame:
        return spark.createDataFrame([], T.StructType([f for f in fields if f.name in kept])).filter(condition)

    def needs(column: str) -> bool:
        try:
            holds([c for c in columns if c != column])
        except AnalysisException:
            return True
        return False

    holds(columns)  # an unknown name or a wrong type is the caller's error
    used = [c for c in columns if needs(c)]
    held = {c: f"__code{k}" for k, c in enumerate(used)}  # apart from the condition's own names
    values = [encoded.plan[c].decode(F.col(held[c])).cast(encoded.meta.column(c).spark_type).alias(c) for c in used]
    cells = domain_frame(spark, {held[c]: list(range(encoded.sizes[c])) for c in used}) if used else spark.range(1)
    allowed = (cells.select(*held.values(), *values) if used else cells).filter(condition)
    if not used:
        if allowed.isEmpty():
            raise LibraryFailure("no code of the model satisfies the condition")
        return None
    return Factor(tuple(model.names[c] for c in used), allowed.select(*[F.col(held[c]).alias(model.names[c]) for c in used], F.lit(1.0).alias("w")))


def sample(model: FactorModel, spark: SparkSession, n: int = DEFAULT_SAMPLES, condition: str | list[str] | None = None, seed: int | None = None) -> DataFrame:
    """``n`` synthetic rows in the original domain; with a condition, rows of the model given the condition.

    A condition's columns come together in one table of their public codes; several conditions, all of which must
    hold, are a table each.
    """
    seed = secrets.randbits(62) if seed is None else seed
    conditions = [condition] if isinstance(condition, str) else list(condition or [])
    evidence = [e for c in conditions if (e := evidence_of(c, model, spark)) is not None]
    return model.encoded.decode(model.draw_codes(spark, n, seed, evidence=evidence))
