"""Registered queries, their SQL twins, and helpers to write noisy SQL.

A query and its SQL stand next to each other.  Seeded noise hashes (seed, tag, keys, index), so SQL with md5
draws the same numbers and the noisy results can be compared, not only the exact ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.exact import grid_digits
from hushframe.functions.noise import Seeded
from hushframe.metadata import TableMeta

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 7
MODE = Seeded(SEED, allow_insecure=True)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold zoneless times, compared as UTC
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# -- SQL text ------------------------------------------------------------------------------------------------


def uni(tag: str, keys: list[str] = (), index: str = "'0'", seed: int = SEED) -> str:
    parts = [f"'{seed}'", f"'{tag}'", *[f"coalesce(cast({k} as varchar), '\\N')" for k in keys], index]
    return f"((cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) as bigint)::double + 0.5::double) / 4503599627370496::double)"


def digest_sql(seed: int, tag: str, keys: list[str]) -> str:
    parts = [f"'{seed}'", f"'{tag}'", *[f"coalesce(cast({k} as varchar), '\\N')" for k in keys], "'0'"]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def num(x: float) -> str:
    return f"{x!r}::double"


def lap(tag: str, keys: list[str], scale: float, seed: int = SEED) -> str:
    c = f"({uni(tag, keys, seed=seed)} - 0.5::double)"
    return f"(-({num(scale)}) * sign({c}) * ln(1::double - 2::double * abs({c})))"


def gauss(tag: str, keys: list[str], sigma: float) -> str:
    u0, u1 = uni(tag, keys), uni(tag, keys, "'1'")
    return f"({num(sigma)} * sqrt(-2::double * ln({u0})) * cos(2::double * pi() * {u1}))"


def gum(tag: str, keys: list[str], scale: float) -> str:
    return f"(-({num(scale)}) * ln(-ln({uni(tag, keys)})))"


def exact(x: str, bound: float) -> str:
    f = num(10.0 ** grid_digits(bound))
    return f"coalesce(sum(floor(({x}) * {f} + 0.5::double)::hugeint)::double / {f}, 0::double)"


def clamp(x: str, low: float, high: float) -> str:
    return f"(case when {x} is not null and not isnan({x}::double) then greatest({num(low)}, least({x}::double, {num(high)})) end)"


def unit(x: str, low: float, high: float) -> str:
    middle, half = (low + high) / 2.0, (high - low) / 2.0 or 1.0
    return f"coalesce(({clamp(x, low, high)} - {num(middle)}) / {num(half)}, 0::double)"


def out(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::double as {name}"


def values(name: str, items: list) -> str:
    rows = ", ".join(f"({v!r})" for v in items)
    return f"(values {rows}) as {name}_d({name})"


# -- declared facts about the given tables (public, round bounds) ---------------------------------------------

FLAGS = ["A", "N", "R"]
STATUSES = ["F", "O"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _float(low, high, **more):
    return {"type": "float", "precision": 64, "lower": low, "upper": high, **more}


def _labels(items, **more):
    return {"type": "string", "cardinality": len(items), "categories": items, **more}


LINEITEM = TableMeta.from_dict({"max_ids": 1, "rows": 60000, "row_privacy": True, "columns": {
    "l_returnflag": _labels(FLAGS), "l_linestatus": _labels(STATUSES),
    "l_linenumber": {"type": "int", "precision": 32, "lower": 1, "upper": 7},
    "l_quantity": _float(0.0, 50.0), "l_extendedprice": _float(0.0, 100000.0), "l_discount": _float(0.0, 0.1),
}})
CUSTOMER = TableMeta.from_dict({"max_ids": 1, "rows": 1500, "row_privacy": True, "columns": {
    "c_custkey": {"type": "int", "precision": 64, "lower": 0, "upper": 2**40, "private_id": True},
    "c_nationkey": {"type": "int", "precision": 32, "cardinality": 25, "categories": list(range(25))},
    "c_acctbal": _float(-1000.0, 10000.0), "c_mktsegment": _labels(SEGMENTS),
}})
SHORT_GROUPS = TableMeta.from_dict({"max_ids": 1, "rows": 15000, "row_privacy": True, "columns": {
    "o_orderpriority": _labels(PRIORITIES, max_partition_length=1500), "o_totalprice": _float(1000.0, 500000.0)}})
ORDERS = TableMeta.from_dict({"max_ids": 4, "rows": 15000, "row_privacy": False, "columns": {
    "o_orderpriority": _labels(PRIORITIES, max_influenced_partitions=2, max_partition_contributions=2),
    "o_custkey": {"type": "int", "precision": 64, "lower": 0, "upper": 2**40, "private_id": True},
    "o_orderstatus": {"type": "string"},
    "o_totalprice": _float(0.0, 500000.0),
    "o_orderdate": {"type": "datetime", "lower": "1992-01-01T00:00:00", "upper": "2002-01-01T00:00:00"},
}})
