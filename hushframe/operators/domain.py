"""Public key domains: groups appear in a release whether or not the data hold them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.literals import constant_array
from hushframe.metadata import TableMeta

MOST_CELLS = 2**63 - 1  # cells are numbered by longs
CELLS_PER_TASK = 100_000
MOST_TASKS = 100_000  # cells are generated one by one, so a task may hold any number of them


def domains_of(meta: TableMeta, columns: list[str], given: dict[str, list] | None = None) -> dict[str, list]:
    given = given or {}
    return {c: list(given[c]) if c in given else meta.column(c).domain for c in columns}


def domain_size(domains: dict[str, list]) -> int:
    return math.prod(len(v) for v in domains.values())


def domain_frame(spark: SparkSession, domains: dict[str, list], types: dict | None = None, number: str | None = None) -> DataFrame:
    """Every combination of the public values, decoded from the cell number of a generated range.

    ``number`` keeps the cell number, in row-major order, under that name.
    """
    cells = domain_size(domains)
    if cells > MOST_CELLS:
        raise InvalidQuery("public domain with more cells than a long can number; use censored keys or fewer columns")
    columns, stride = [F.col("id").alias(number)] if number else [], cells
    for name, values in domains.items():
        stride //= len(values)
        at = F.expr(f"int((id div {stride}L) % {len(values)}L)")
        value = at if list(values) == list(range(len(values))) else F.element_at(constant_array(values), at + 1)
        columns.append((value.cast(types[name]) if types and name in types else value).alias(name))
    return spark.range(0, cells, 1, min(MOST_TASKS, max(1, cells // CELLS_PER_TASK))).select(*columns)


def complete(counts: DataFrame, domains: dict[str, list], fill: list[str]) -> DataFrame:
    """Left join from the public domain; missing groups get 0 in the ``fill`` columns.

    The keys are compared null-safe: a plain equality would make the optimizer push ``key IS NOT NULL`` below
    the aggregate, where a computed key (a hash, a nearest centre) is worked out again for every row.
    """
    types = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    frame = domain_frame(counts.sparkSession, domains, types)
    found = counts.withColumnsRenamed({k: f"__of_{k}" for k in domains})
    same = F.lit(True)
    for k in domains:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    joined = frame.join(found, same, "left").drop(*[f"__of_{k}" for k in domains])
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(types[c])) for c in fill})


def clamped(column: str | Column, lower: float, upper: float) -> Column:
    """Value moved into [lower, upper]; null and NaN stay missing instead of becoming a bound."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.greatest(F.lit(lower), F.least(c, F.lit(upper))))
