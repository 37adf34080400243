"""Reversible column transformers between a table's domain and codes, all column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.literals import constant_array
from hushframe.functions.ranges import edges_at_or_below
from hushframe.functions.uniform import digest
from hushframe.metadata import TableMeta
from hushframe.operators.domain import clamped
from hushframe.operators.marginals import bin_code

# Bins of a continuous column, and the two styles of default plans.
DEFAULT_BINS = 10
STYLES = ("cube", "gan")
MICROS_PER_DAY = 86_400_000_000
SEARCHED = 16  # categories from which on a value is searched for by halving


def position_in(c: Column, categories: tuple) -> Column:
    """Place of a value in a list, null if it has none: by halving the sorted list, then one comparison."""
    if len(categories) < SEARCHED:
        at = F.array_position(F.array(*map(F.lit, categories)), c).cast("int")
        return F.when(at > 0, at - 1)
    places = {v: k for k, v in reversed(list(enumerate(categories)))}
    ordered = sorted(places)
    below = F.greatest(edges_at_or_below(c, ordered), F.lit(1))
    found = F.element_at(constant_array(ordered), below) == c
    return F.when(found, F.element_at(constant_array([places[v] for v in ordered]), below))


@dataclass(frozen=True)
class Label:
    """Category to its position; null to one extra code when ``nullable``."""

    categories: tuple
    nullable: bool = False

    @property
    def codes(self) -> int:
        return len(self.categories) + self.nullable

    def encode(self, c: Column) -> Column:
        code = position_in(c, self.categories)
        return F.when(c.isNull(), F.lit(len(self.categories))).otherwise(code) if self.nullable else code

    def decode(self, c: Column) -> Column:
        inside = c.between(0, len(self.categories) - 1)
        return F.when(inside, F.element_at(F.array(*map(F.lit, self.categories)), (c + 1).cast("int")))


@dataclass(frozen=True)
class OneHot:
    """Code 0 … n-1 to an indicator array, and back by its largest element."""

    n: int

    def encode(self, c: Column) -> Column:
        return F.when(c.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(self.n - 1)), lambda i: (i == c).cast("int")))

    def decode(self, c: Column) -> Column:
        return (F.array_position(c, F.array_max(c)) - 1).cast("int")


@dataclass(frozen=True)
class MinMax:
    """[lower, upper] onto [-1, 1]; with ``nullable`` an array of that and of 1 for a missing value, which is then at the middle."""

    lower: float
    upper: float
    nullable: bool = False

    def encode(self, c: Column) -> Column:
        scaled = (clamped(c, self.lower, self.upper) - F.lit(self.lower)) * F.lit(2.0 / (self.upper - self.lower)) - F.lit(1.0)
        if not self.nullable:
            return scaled
        return F.array(F.coalesce(scaled, F.lit(0.0)), scaled.isNull().cast("double"))

    def decode(self, c: Column) -> Column:
        scaled = F.when(c[1] < 0.5, c[0]) if self.nullable else c
        return (scaled + F.lit(1.0)) * F.lit((self.upper - self.lower) / 2.0) + F.lit(self.lower)


@dataclass(frozen=True)
class Bins:
    """Equal-width bins; decoding gives the bin's midpoint; null to one extra code when ``nullable``."""

    lower: float
    upper: float
    bins: int = DEFAULT_BINS
    nullable: bool = False

    @property
    def codes(self) -> int:
        return self.bins + self.nullable

    def encode(self, c: Column) -> Column:
        code = bin_code(c, self.lower, self.upper, self.bins)
        return F.coalesce(code, F.lit(self.bins)) if self.nullable else code

    def decode(self, c: Column) -> Column:
        width = (self.upper - self.lower) / self.bins
        return F.when(c.between(0, self.bins - 1), F.lit(self.lower) + (c + F.lit(0.5)) * F.lit(width))


@dataclass(frozen=True)
class DaysSince:
    """Datetime to days (with fraction) after ``epoch``."""

    epoch: datetime

    def _micros(self) -> Column:
        return F.lit(int((self.epoch.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1_000_000))

    def encode(self, c: Column) -> Column:
        return (F.unix_micros(c.cast("timestamp")) - self._micros()) / F.lit(float(MICROS_PER_DAY))

    def decode(self, c: Column) -> Column:
        return F.timestamp_micros(self._micros() + F.round(c * F.lit(float(MICROS_PER_DAY))).cast("bigint"))


@dataclass(frozen=True)
class Clamp:
    lower: float
    upper: float

    def encode(self, c: Column) -> Column:
        return clamped(c, self.lower, self.upper)

    def decode(self, c: Column) -> Column:
        return c


@dataclass(frozen=True)
class Anonymize:
    """A private id becomes a fresh random id; with a seed, a repeatable one for tests."""

    seed: int | None = None

    def encode(self, c: Column) -> Column:
        return F.expr("uuid()") if self.seed is None else digest(self.seed, "anonymize", c)

    def decode(self, c: Column) -> Column:
        return c


@dataclass(frozen=True)
class Chain:
    steps: tuple

    @property
    def codes(self) -> int:
        return self.steps[-1].codes

    def encode(self, c: Column) -> Column:
        for step in self.steps:
            c = step.encode(c)
        return c

    def decode(self, c: Column) -> Column:
        for step in reversed(self.steps):
            c = step.decode(c)
        return c


def default_plan(meta: TableMeta, columns: list[str] | None = None, style: str = "cube", nullable: bool = False,
                 overrides: dict | None = None) -> dict:
    """Transformer per column from its declared kind; ``overrides`` win, for selected columns only."""
    if style not in STYLES:
        raise InvalidQuery(f"unknown transformer style {style!r}")
    names = list(columns or meta.columns)
    overrides = overrides or {}
    stray = [c for c in overrides if c not in names]
    if stray:
        raise InvalidQuery(f"constraints for columns that are not selected: {', '.join(stray)}")
    plan = {}
    for name in names:
        declared = meta.column(name)
        if name in overrides:
            plan[name] = overrides[name]
        elif declared.private_id:
            plan[name] = Anonymize()
        elif declared.kind == "categorical":
            label = Label(tuple(declared.domain), nullable)
            plan[name] = label if style == "cube" else Chain((label, OneHot(label.codes)))
        elif declared.kind == "continuous":
            low, high = float(declared.lower), float(declared.upper)
            plan[name] = Bins(low, high, DEFAULT_BINS, nullable) if style == "cube" else MinMax(low, high, nullable)
        else:
            days = (declared.upper - declared.lower).total_seconds() / 86_400.0
            last = Bins(0.0, days, DEFAULT_BINS, nullable) if style == "cube" else MinMax(0.0, days, nullable)
            plan[name] = Chain((DaysSince(declared.lower), last))
    return plan


def encode(df: DataFrame, plan: dict) -> DataFrame:
    return df.select(*[t.encode(F.col(c)).alias(c) for c, t in plan.items()])


def decode(df: DataFrame, plan: dict, meta: TableMeta | None = None) -> DataFrame:
    """Codes back to the table's domain, in the plan's column order and, given metadata, declared types."""
    out = []
    for c, t in plan.items():
        value = t.decode(F.col(c))
        out.append((value.cast(meta.column(c).spark_type) if meta else value).alias(c))
    return df.select(*out)
