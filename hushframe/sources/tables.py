"""Private tables: readers with a declared schema, text lines, and the owner-side conformance report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.errors import InvalidQuery
from hushframe.metadata import TableMeta
from hushframe.operators.clean import missing


def read_private(spark: SparkSession, meta: TableMeta, uri: str, format: str | None = None) -> DataFrame:
    """Lazy table with the declared columns and types; any Hadoop file system (``s3a://``, ``hdfs://``, local).

    CSV columns are found by header name; a value that does not fit its type fails the job.  Without
    ``format`` the suffix decides, and anything but ``.csv`` and ``.parquet`` is refused.
    """
    kind = format or ("csv" if uri.endswith(".csv") else "parquet" if uri.endswith(".parquet") else None)
    if kind == "csv":
        present = spark.read.option("header", True).csv(uri).columns
        _require(meta, present)
        declared = {f.name: f for f in meta.to_struct().fields}
        schema = T.StructType([declared.get(n, T.StructField(n, T.StringType())) for n in present])
        table = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(uri)
        return table.select(*meta.columns)
    if kind == "parquet":
        return from_frame(meta, spark.read.parquet(uri))
    raise InvalidQuery(f"cannot read {uri}: only CSV and Parquet tables are supported")


def from_frame(meta: TableMeta, df: DataFrame) -> DataFrame:
    """Any DataFrame as a private table: declared columns, declared types, the rest dropped."""
    _require(meta, df.columns)
    fields = meta.to_struct().fields
    columns = []
    for f in fields:
        # an equal type stays a bare column, so that filters still reach the scan
        plain = df.schema[f.name].dataType == f.dataType
        columns.append((F.col(f.name) if plain else F.col(f.name).cast(f.dataType)).alias(f.name, metadata=f.metadata))
    return df.select(*columns)


def _require(meta: TableMeta, present: list[str]) -> None:
    lacking = [c for c in meta.columns if c not in present]
    if lacking:
        raise InvalidQuery(f"table lacks declared columns: {', '.join(lacking)}")


def split_lines(df: DataFrame, separator: str, names: list[str], value: str = "value") -> DataFrame:
    """Delimited text lines into named string columns."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return df.select(F.from_csv(value, schema, {"sep": separator}).alias("r")).select("r.*")


def typed_decode(df: DataFrame, meta: TableMeta) -> DataFrame:
    """String-typed table to declared types; datetimes parsed."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in meta.to_struct(df.columns).fields])


def iso_datetimes(df: DataFrame) -> DataFrame:
    """Datetime columns as ``yyyy-MM-ddTHH:mm:ss`` text."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in stamps})


def conformance(df: DataFrame, meta: TableMeta) -> DataFrame:
    """Per column: rows out of bounds, out of domain, and null where none was declared.

    For the data owner only: the counts are exact.  One pass, then the single row is turned into rows.
    """
    counts, names = [], list(meta.columns)
    for i, name in enumerate(names):
        c, declared = F.col(name), meta.columns[name]
        gone = missing(name, df.schema[name].dataType)
        if declared.categories is not None:
            outside, off_domain = F.lit(False), ~c.isin(*declared.categories)
        elif declared.bounded:
            outside, off_domain = ~c.between(F.lit(declared.lower), F.lit(declared.upper)), F.lit(False)
        else:
            outside = off_domain = F.lit(False)
        unexpected = F.lit(False) if declared.nullable else gone
        counts += [
            F.count_if(~gone & outside).alias(f"b{i}"),
            F.count_if(~gone & off_domain).alias(f"d{i}"),
            F.count_if(unexpected).alias(f"n{i}"),
        ]
    entries = F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(f"b{i}").alias("out_of_bounds"), F.col(f"d{i}").alias("out_of_domain"),
                 F.col(f"n{i}").alias("unexpected_nulls")) for i, n in enumerate(names)])
    return df.agg(*counts).select(F.explode(entries).alias("e")).select("e.*")
