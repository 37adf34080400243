"""Random tables that look like the private one, made from public metadata only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.errors import InternalFailure
from hushframe.functions.uniform import uniform
from hushframe.metadata import Column, TableMeta

# Default size and seed, one-character strings for free text, null draws per nullable column.
DEFAULT_ROWS = 100
DEFAULT_SEED = 42
CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
NULL_DRAWS = 5


def dummy(spark: SparkSession, meta: TableMeta, n: int = DEFAULT_ROWS, seed: int = DEFAULT_SEED, keep_id: bool = False) -> DataFrame:
    """``n`` rows; equal for equal seeds on any cluster, since each value hashes (seed, column, row)."""
    rows = spark.range(n)
    values = [_nulls(_value(c, seed), c, n, seed).cast(c.spark_type).alias(c.name) for c in meta.columns.values()]
    return rows.select(*(["id"] if keep_id else []), *values)


def dummy_like(rows: DataFrame, id_column: str, meta: TableMeta, seed: int = DEFAULT_SEED, n: int = 0) -> DataFrame:
    """One dummy row per row of an existing table (same count), without reading its values but the id.

    Given ``n``, nullable columns have the nulls of a dummy table of ids below ``n``.
    """
    keyed = rows.select(F.col(id_column).alias("id"))
    return keyed.select("id", *[_nulls(_value(c, seed), c, n, seed).cast(c.spark_type).alias(c.name) for c in meta.columns.values()])


def _pick(values: list, u: SparkColumn) -> SparkColumn:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def _value(c: Column, seed: int) -> SparkColumn:
    u = uniform(seed, c.name, "id")
    if c.categories is not None:
        return _pick(list(c.categories), u)
    if c.type == "string":
        return F.substring(F.lit(CHARACTERS), F.floor(u * len(CHARACTERS)).cast("int") + 1, F.lit(1))
    if c.type == "boolean":
        return u < 0.5
    if c.type == "int":
        return F.lit(c.lower) + F.floor(u * float(c.upper - c.lower + 1))
    if c.type == "float":
        return F.lit(float(c.lower)) + F.lit(float(c.upper - c.lower)) * u
    if c.type == "datetime":
        days = (c.upper - c.lower).days
        return F.timestamp_micros(F.lit(_micros(c.lower)) + F.floor(u * float(days + 1)) * F.lit(86_400_000_000))
    raise InternalFailure(f"no dummy values for type {c.type}")


def _nulls(value: SparkColumn, c: Column, n: int, seed: int) -> SparkColumn:
    if not c.nullable or n == 0:
        return value
    hit = F.lit(False)
    for i in range(NULL_DRAWS):
        hit = hit | (F.col("id") == F.floor(uniform(seed, f"{c.name}|null", index=i) * float(n)))
    return F.when(~hit, value)


def _micros(moment: datetime) -> int:
    return int((moment.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
