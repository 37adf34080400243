"""Running sums per key that do not put a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.ranges import edge_position, edges_at_or_below

CHUNK_ROWS = 100_000  # rows of a chunk, about
FEWEST, MOST = 256, 4096


def chunk_edges(df: DataFrame, order: str) -> list:
    """Cut points of one order column."""
    return order_edges(df, [order])[0]


def order_edges(df: DataFrame, order: list[str]) -> list[list]:
    """Cut points of the first order column, and of the second where rows share a cut's value; as many as the rows ask for.

    One sketch pass; another for tables that need more than the fewest cuts, and for the second column.
    """
    rows, first = _cuts(df, order[0], FEWEST)
    pieces = min(MOST, max(FEWEST, -(-rows // CHUNK_ROWS)))
    if pieces > FEWEST:
        first = _cuts(df, order[0], pieces)[1]
    found = [first]
    if len(set(first)) < len(first) and len(order) > 1:
        found.append(_cuts(df, order[1], pieces)[1])
    return [sorted(set(f)) for f in found]


def _cuts(df: DataFrame, column: str, pieces: int) -> tuple[int, list]:
    """Rows, and values that cut them into about equal pieces."""
    shares = F.percentile_approx(F.col(column).cast("double"), [i / pieces for i in range(1, pieces)], 4 * pieces)
    row = df.agg(F.count("*").alias("n"), shares.alias("cuts")).first()
    return row["n"], row["cuts"] or []


def chunk_of(order: list[str], edges: list[list]) -> Column:
    """Number of a chunk, rising with the order.

    Rows that share an edge's value of the first column are cut by the second one, so that equal values of the
    first column, however many, do not stay together.
    """
    if len(edges) < 2 or not edges[1]:
        return F.coalesce(edges_at_or_below(F.col(order[0]).cast("double"), edges[0]), F.lit(0)).cast("bigint")
    first = F.coalesce(edge_position(F.col(order[0]), edges[0]), F.lit(0))
    second = F.coalesce(edges_at_or_below(F.col(order[1]).cast("double"), edges[1]), F.lit(0))
    return (first * (len(edges[1]) + 1)).cast("bigint") + F.when(first % 2 == 1, second).otherwise(F.lit(0))


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], edges: list | None = None,
                 inclusive: bool = True) -> DataFrame:
    """Append running sums in the given order within each key.

    Rows are ranked inside (key, chunk of the order), so a key with most of the rows is spread over all chunks;
    totals of earlier chunks are added from a table of one row per key and chunk.  Rows stay partitioned by
    (key, chunk) for that join, so they are shuffled once.  Keys must not be null.  Sums of decimals keep the
    type of what is summed, digits and all.
    """
    edges = order_edges(df, order) if edges is None else edges
    edges = edges if edges and isinstance(edges[0], list) else [edges]
    kinds = [f.dataType for f in df.select(*[c.alias(n) for n, c in sums.items()]).schema.fields]
    kept = lambda c, t: c.cast(t) if isinstance(t, T.DecimalType) else c
    columns = list(zip(sums.values(), kinds))
    tagged = df.withColumn("__chunk", chunk_of(order, edges))
    inner = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = {f"__s{i}": kept(F.sum(c).over(inner), t) - (kept(F.lit(0), t) if inclusive else F.coalesce(c, F.lit(0))) for i, (c, t) in enumerate(columns)}
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "__chunk").agg(*[kept(F.sum(c), t).alias(f"__t{i}") for i, (c, t) in enumerate(columns)])
        .select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__ochunk"),
                *[F.coalesce(kept(F.sum(f"__t{i}").over(earlier), t), kept(F.lit(0), t)).alias(f"__o_{i}") for i, t in enumerate(kinds)])
    )
    same = F.col("__chunk") == F.col("__ochunk")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__o{i}"))
    joined = tagged.withColumns(part).join(offsets, same, "left")
    out = {name: kept(kept(F.col(f"__s{i}"), t) + F.col(f"__o_{i}"), t) for i, (name, t) in enumerate(zip(sums, kinds))}
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])
