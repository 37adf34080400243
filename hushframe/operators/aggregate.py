"""Grouped private aggregates: filter, bound, clamp, one aggregation, public keys, noise, derived values."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.exact import exact_sum
from hushframe.functions.noise import Noise, Secure, Seeded, add_noise, threshold
from hushframe.metadata import TableMeta
from hushframe.operators.bounding import bound_contributions, bound_partition_length, bound_partitions
from hushframe.operators.domain import clamped, complete, domains_of
from hushframe.plans.accounting import Cost, check_budget, gaussian_sigma, grouped_cost
from hushframe.plans.primitives import Aggregate, Primitive, distinct_primitives, mechanisms_for
from hushframe.session import written


@dataclass(frozen=True)
class PrivateQuery:
    """A private aggregate query over one table, priced without touching data.

    ``unit`` names the column of the privacy unit, ``row_key`` the columns that identify a row, used to choose
    which rows survive bounding.  Where the table declares that a row is not a unit, the unit defaults to its
    declared private id and the row key to all declared columns; without either the query is refused, since
    nothing would hold a unit to its ``max_ids`` rows.
    """

    meta: TableMeta
    aggs: tuple[Aggregate, ...]
    epsilon: float
    delta: float = 0.0
    by: tuple[str, ...] = ()
    mechanisms: dict | None = None
    unit: str | None = None
    row_key: tuple[str, ...] = ()
    where: Column | str | None = None
    domains: dict | None = None
    censor: bool | None = None
    postprocess: bool = True
    tag: str = "query"
    bound_seed: int = 0

    def __post_init__(self):
        check_budget(self.epsilon, self.delta)
        if not self.aggs:
            raise InvalidQuery("a query needs an aggregate")
        chosen = mechanisms_for(self.mechanisms)
        for name in self.by:
            if not self.domains or name not in self.domains:
                self.meta.column(name)
        for primitive in self.primitives:
            if primitive.column:
                self.meta.column(primitive.column)
            if chosen[self._statistic(primitive)] == "gaussian" and self.delta <= 0:
                raise InvalidQuery("Gaussian noise needs a positive delta")
        if self.censored and self.delta <= 0:
            raise InvalidQuery("censored keys need a positive delta")
        if self.unit is None and not self.meta.row_privacy:
            if self.meta.private_id is None:
                raise InvalidQuery("rows are not privacy units here: name the unit")
            object.__setattr__(self, "unit", self.meta.private_id)
            object.__setattr__(self, "row_key", self.row_key or tuple(self.meta.columns))
        if self.unit and not self.row_key:
            raise InvalidQuery("bounding by a unit needs row_key columns")
        if self.group_length and not self.row_key:
            raise InvalidQuery("bounding the length of a group needs row_key columns")

    @property
    def censored(self) -> bool:
        return bool(self.by) and (self.meta.censor_dims if self.censor is None else self.censor)

    @property
    def key_size(self) -> Primitive:
        """The noisy group size the threshold looks at."""
        return Primitive("units", self.unit) if self.unit else Primitive("count")

    @property
    def primitives(self) -> list[Primitive]:
        found = distinct_primitives(list(self.aggs))
        if self.censored and self.key_size not in found:
            found.append(self.key_size)
        return found

    def cost(self) -> Cost:
        return grouped_cost(len(self.primitives), self.epsilon, self.delta)

    # -- contribution limits ------------------------------------------------------------------------

    def _limit(self, name: str) -> int | None:
        limits = [getattr(self.meta.columns[c], name) for c in self.by if c in self.meta.columns]
        limits = [v for v in limits if v is not None]
        return min(limits) if limits else None

    @property
    def groups_per_unit(self) -> int:
        return min(self.meta.max_ids, self._limit("max_influenced_partitions") or self.meta.max_ids)

    @property
    def rows_per_group(self) -> int:
        return min(self.meta.max_ids, self._limit("max_partition_contributions") or self.meta.max_ids)

    @property
    def group_length(self) -> int | None:
        """Declared most rows of a group."""
        return self._limit("max_partition_length")

    @property
    def rows_per_unit(self) -> int:
        if self.unit is None:
            return self.meta.max_ids
        return min(self.meta.max_ids, self.groups_per_unit * self.rows_per_group)

    def bound(self, df: DataFrame) -> DataFrame:
        """Apply the user filter, then enforce every declared limit."""
        if self.where is not None:
            df = df.filter(self.where)
        if self.unit is not None:
            df = self._bound_unit(df)
        if self.group_length:
            df = bound_partition_length(df, list(self.by), self.group_length, list(self.row_key), self.bound_seed)
        return df

    def _bound_unit(self, df: DataFrame) -> DataFrame:
        if self._limit("max_influenced_partitions") or self._limit("max_partition_contributions"):
            df = bound_partitions(df, self.unit, list(self.by), self.groups_per_unit, self.rows_per_group,
                                  list(self.row_key), self.bound_seed)
        return bound_contributions(df, self.unit, self.meta.max_ids, list(self.row_key), self.bound_seed)

    # -- noise ----------------------------------------------------------------------------------------

    def _statistic(self, primitive: Primitive) -> str:
        return "threshold" if primitive.kind == "units" else primitive.statistic(self.meta)

    def sensitivity(self, primitive: Primitive) -> float:
        if primitive.kind == "units":
            return float(self.groups_per_unit)
        bound = primitive.bound(self.meta)
        if self.group_length and primitive.kind == "sum":
            # a row that enters a full group pushes another one out
            declared = self.meta.column(primitive.column)
            bound = max(bound, float(declared.upper) - float(declared.lower))
        return self.rows_per_unit * bound

    def noise_of(self, primitive: Primitive) -> Noise:
        mechanism = mechanisms_for(self.mechanisms)[self._statistic(primitive)]
        size = self.sensitivity(primitive)
        if mechanism == "laplace":
            return Noise(primitive.name, "laplace", size / self.epsilon)
        return Noise(primitive.name, "gaussian", gaussian_sigma(size, self.epsilon, self.delta / 2.0))

    @property
    def tau(self) -> float:
        """A group of one unit passes with probability at most delta (Wilson et al. 2020).

        Without a unit column group sizes count rows, and one unit may bring ``max_ids`` of them.
        """
        groups = self.groups_per_unit if self.unit else self.meta.max_ids
        alone = 1.0 if self.unit else float(self.meta.max_ids)
        noise = self.noise_of(self.key_size)
        keep = (1.0 - self.delta) ** (1.0 / groups)
        if noise.mechanism == "laplace":
            return alone - noise.scale * math.log(2.0 - 2.0 * keep)
        return alone + noise.scale * NormalDist().inv_cdf(keep)

    # -- the job ---------------------------------------------------------------------------------------

    def exact(self, df: DataFrame, bounded: bool = False) -> DataFrame:
        """Bounded primitives per group, without noise: private, never shown."""
        rows = df if bounded else self.bound(df)
        columns = [self._aggregate_column(p).alias(p.name) for p in self.primitives]
        grouped = rows.groupBy(*self.by).agg(*columns) if self.by else rows.agg(*columns)
        if not self.by or self.censored:
            return grouped
        return complete(grouped, domains_of(self.meta, list(self.by), self.domains), [p.name for p in self.primitives])

    def _aggregate_column(self, primitive: Primitive) -> Column:
        if primitive.kind == "units":
            return F.count_distinct(self.unit)
        if primitive.kind == "count" and (primitive.column is None or self.meta.column(primitive.column).type != "float"):
            return F.count(primitive.column or F.lit(1))
        declared = self.meta.column(primitive.column)
        value = clamped(primitive.column, declared.lower, declared.upper).cast("double")
        if primitive.kind == "count":
            return F.count(value)  # NaN is missing, in the count of an average as in its sum
        value = value * value if primitive.kind == "sumsq" else value
        return exact_sum(value, primitive.bound(self.meta))

    def derived(self, renamed: dict[str, str] | None = None, prefix: str = "") -> list[Column]:
        """The requested columns as functions of the noisy primitives: post-processing, free."""
        renamed = renamed or {}
        out = []
        for agg in self.aggs:
            part = {p.kind: F.col(renamed.get(p.name, p.name)) for p in agg.primitives()}
            out.append(_derive(agg.function, part).alias(prefix + agg.label))
        return out

    def noisy(self, df: DataFrame, mode: Secure | Seeded, exact: DataFrame | None = None) -> DataFrame:
        exact = self.exact(df) if exact is None else exact
        noisy = add_noise(exact, [self.noise_of(p) for p in self.primitives], list(self.by), mode, self.tag)
        if self.censored:
            noisy = threshold(noisy, self.key_size.name, self.tau)
        result = noisy.select(*self.by, *self.derived())
        return result if self.postprocess else positional(result)


def _derive(function: str, part: dict[str, Column]) -> Column:
    if function in ("count", "sum"):
        return part[function]
    mean = F.when(part["count"] > 0, part["sum"] / part["count"])
    if function == "avg":
        return mean
    spread = F.when(part["count"] > 0, F.greatest(F.lit(0.0), part["sumsq"] / part["count"] - mean * mean))
    return F.sqrt(spread) if function == "std" else spread


def positional(df: DataFrame) -> DataFrame:
    """Names ``res_0 … res_k`` for a release without post-processing."""
    return df.toDF(*[f"res_{i}" for i in range(len(df.columns))])


def private_agg(df: DataFrame, meta: TableMeta, aggs, *, noise: Secure | Seeded | None = None, path: str | None = None, **options):
    """Run a private query.  With secure noise the release is written once and the stored rows returned.

    Options are those of ``PrivateQuery``.
    """
    for key in ("by", "row_key"):
        if key in options:
            options[key] = tuple(options[key])
    query = PrivateQuery(meta=meta, aggs=tuple(aggs), **options)
    mode = noise or Secure()
    result = query.noisy(df, mode)
    return result if isinstance(mode, Seeded) else written(result, "release", path)


@dataclass(frozen=True)
class Composition:
    """Several measurements of one grouped frame: one pass over the data, costs added up."""

    queries: tuple[PrivateQuery, ...]

    def __post_init__(self):
        first = self.queries[0]
        for q in self.queries:
            same = (q.by, q.unit, q.row_key, q.meta.max_ids, q.bound_seed) == (
                first.by, first.unit, first.row_key, first.meta.max_ids, first.bound_seed)
            if not same or q.where is not first.where or q.censored or not q.postprocess:
                raise InvalidQuery("composed measurements must share filter, keys and bounds")
        tags = [q.tag for q in self.queries]
        if len(set(tags)) != len(tags):
            raise InvalidQuery("composed measurements need distinct tags")

    def cost(self) -> Cost:
        return sum((q.cost() for q in self.queries[1:]), self.queries[0].cost())

    def noisy(self, df: DataFrame, mode: Secure | Seeded) -> DataFrame:
        first = self.queries[0]
        union = replace(first, aggs=tuple(a for q in self.queries for a in q.aggs))
        table = union.exact(df)
        selected = [F.col(c) for c in first.by]
        for q in self.queries:
            renamed = {p.name: f"{q.tag}__{p.name}" for p in q.primitives}
            noises = [replace(q.noise_of(p), out=renamed[p.name]) for p in q.primitives]
            table = add_noise(table, noises, list(first.by), mode, q.tag)
            selected += q.derived(renamed, f"{q.tag}_")
        return table.select(*selected)


def compose(queries: list[PrivateQuery]) -> Composition:
    return Composition(tuple(queries))
