"""Aggregates a private query may ask for, and the shared primitives that carry the noise."""

from __future__ import annotations

from dataclasses import dataclass

from hushframe.errors import InvalidQuery
from hushframe.metadata import TableMeta

# Statistics whose noise mechanism a caller may choose.
STATISTICS = ("count", "sum_int", "sum_large_int", "sum_float", "threshold")
CHOICES = ("laplace", "gaussian")


@dataclass(frozen=True)
class Primitive:
    """One noisy number per group: a count, a sum or a sum of squares."""

    kind: str
    column: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column or 'rows'}"

    def statistic(self, meta: TableMeta) -> str:
        return "count" if self.kind == "count" else meta.column(self.column).statistic

    def bound(self, meta: TableMeta) -> float:
        """Largest change one row can cause."""
        if self.kind == "count":
            return 1.0
        size = meta.column(self.column).max_abs
        return size if self.kind == "sum" else size * size


# Primitives behind each aggregate.
PARTS = {
    "count": ("count",),
    "sum": ("sum",),
    "avg": ("count", "sum"),
    "std": ("count", "sum", "sumsq"),
    "var": ("count", "sum", "sumsq"),
}


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None
    name: str | None = None

    def __post_init__(self):
        if self.function not in PARTS:
            raise InvalidQuery(f"unsupported aggregate {self.function!r}")
        if self.column is None and self.function != "count":
            raise InvalidQuery(f"{self.function} needs a column")

    @property
    def label(self) -> str:
        return self.name or f"{self.function}_{self.column or 'rows'}"

    def alias(self, name: str) -> Aggregate:
        return Aggregate(self.function, self.column, name)

    def primitives(self) -> list[Primitive]:
        return [Primitive(kind, self.column) for kind in PARTS[self.function]]


def count(column: str | None = None) -> Aggregate:
    return Aggregate("count", column)


def sum_(column: str) -> Aggregate:
    return Aggregate("sum", column)


def avg(column: str) -> Aggregate:
    return Aggregate("avg", column)


def std(column: str) -> Aggregate:
    return Aggregate("std", column)


def var(column: str) -> Aggregate:
    return Aggregate("var", column)


def distinct_primitives(aggregates: list[Aggregate]) -> list[Primitive]:
    """Each primitive once, in first-use order: the budget depends on this sharing."""
    return list(dict.fromkeys(p for a in aggregates for p in a.primitives()))


def mechanisms_for(chosen: dict[str, str] | None) -> dict[str, str]:
    chosen = chosen or {}
    for statistic, mechanism in chosen.items():
        if statistic not in STATISTICS or mechanism not in CHOICES:
            raise InvalidQuery(f"mechanism {mechanism!r} for {statistic!r} is not available")
    return {s: chosen.get(s, "laplace") for s in STATISTICS}
