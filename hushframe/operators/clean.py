"""Row-wise cleaning and imputation of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.errors import InvalidQuery
from hushframe.functions.noise import Secure, Seeded
from hushframe.metadata import TableMeta
from hushframe.operators.aggregate import PrivateQuery
from hushframe.operators.order_stats import exact_quantiles
from hushframe.plans.primitives import avg

# What an unparsable field becomes, by type.
DEFAULTS = {"double": 0.0, "float": 0.0, "int": 0, "bigint": 0, "string": "", "boolean": False}


def select_cols(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidQuery(f"unknown columns: {', '.join(missing)}")
    return df.select(*columns)


def cast_default(column: str | Column, type_name: str, default=None) -> Column:
    """Cast; text that does not parse, and a missing value, become the type's default."""
    if type_name not in DEFAULTS:
        raise InvalidQuery(f"no default for type {type_name!r}")
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast(type_name), F.lit(DEFAULTS[type_name] if default is None else default).cast(type_name))


def missing(column: str, data_type: T.DataType) -> Column:
    null = F.col(column).isNull()
    return null | F.isnan(column) if isinstance(data_type, (T.DoubleType, T.FloatType)) else null


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the commonest value of each column, the smallest on ties.

    Each column is counted on its own with map-side partial counts, so a scan reads that column only and a
    near-unique column spreads over the cluster instead of filling one aggregation buffer.
    """
    frame = None
    for c in columns:
        kept = df.filter(~missing(c, df.schema[c].dataType)).select(c)
        best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(c).alias("v")))["v"].alias(c)
        top = kept.groupBy(c).agg(F.count("*").alias("__n")).agg(best)
        row = top.select(*[F.col(o) if o == c else F.lit(None).cast(df.schema[o].dataType).alias(o) for o in columns])
        frame = row if frame is None else frame.unionByName(row)
    return frame.agg(*[F.max(c).alias(c) for c in columns])


def impute(df: DataFrame, strategy: str) -> DataFrame:
    """Fill missing values from the table itself; reads private data without noise (see ``impute_private``)."""
    if strategy == "drop":
        return drop_missing(df)
    if strategy not in ("mean", "median", "most_frequent"):
        raise InvalidQuery(f"imputation strategy {strategy!r} is not supported")
    numeric = [] if strategy == "most_frequent" else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
    ]
    others = [c for c in df.columns if c not in numeric]
    values: dict = {}
    if numeric and strategy == "mean":
        plain = {c: F.when(~missing(c, df.schema[c].dataType), F.col(c).cast("double")) for c in numeric}
        values.update(df.agg(*[F.avg(v).alias(c) for c, v in plain.items()]).first().asDict())
    elif numeric:
        values.update({c: v[0] for c, v in exact_quantiles(df, numeric, [0.5]).items()})
    if others:
        values.update(most_frequent(df, others).first().asDict())
    return _filled(df, values)


def _filled(df: DataFrame, values: dict) -> DataFrame:
    """Replace missing values, keeping every column's type."""
    columns = []
    for f in df.schema.fields:
        value = values.get(f.name)
        if value is None:
            columns.append(F.col(f.name))
        else:
            fill = F.lit(value).cast(f.dataType)
            columns.append(F.when(missing(f.name, f.dataType), fill).otherwise(F.col(f.name)).alias(f.name))
    return df.select(*columns)


def impute_private(df: DataFrame, meta: TableMeta, columns: list[str], epsilon: float, mode: Secure | Seeded | None = None,
                   tag: str = "impute") -> DataFrame:
    """Fill missing numbers with noisy means: costs two primitives of ``epsilon`` per column."""
    query = PrivateQuery(meta=meta, aggs=tuple(avg(c) for c in columns), epsilon=epsilon, tag=tag)
    values = query.noisy(df, mode or Secure()).first().asDict()
    bounded = {}
    for c in columns:
        declared, value = meta.column(c), values[f"avg_{c}"]
        value = (declared.lower + declared.upper) / 2.0 if value is None else value
        bounded[c] = min(max(value, declared.lower), declared.upper)
    return _filled(df, bounded)


def fill_release(df: DataFrame, value: str = "") -> DataFrame:
    """Blank text for nulls in the string columns of a release."""
    return df.na.fill(value)


def check_release(df: DataFrame) -> DataFrame:
    """Refuse a stored release that is empty or has a missing cell; the draw is never repeated."""
    gaps = None
    for f in df.schema.fields:
        gap = missing(f.name, f.dataType)
        gaps = gap if gaps is None else gaps | gap
    seen = df.agg(F.count("*").alias("n"), F.count(F.when(gaps, 1)).alias("gaps")).first()
    if seen["n"] == 0 or seen["gaps"]:
        raise InvalidQuery("the release is empty or has missing cells; use a larger budget or fewer groups")
    return df


def release_defects(df: DataFrame) -> DataFrame:
    """The same check as a table: rows, and missing cells per column."""
    gaps = [F.count(F.when(missing(f.name, f.dataType), 1)).alias(f"missing_{f.name}") for f in df.schema.fields]
    return df.agg(F.count("*").alias("n_rows"), *gaps)
