"""Contribution bounding: keep a hash-random, repeatable subset of each unit's or group's rows.

Scale notes.  A row limit of up to ``MAP_SIDE_LIMIT`` is a rank filter, which Spark turns into a
WindowGroupLimit below the shuffle: a hot unit leaves at most that many rows per map task.  Larger
limits find the n-th smallest hash of each group by refining the hash digits from counts, and are then a filter:
no task sorts a group, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.uniform import digest
from hushframe.operators.repeat import repeat_rows
from hushframe.session import Scratch, written

MAP_SIDE_LIMIT = 64
BUCKET_HEX_DIGITS = 4


def row_order(order: list[str], seed: int, tag: str = "bound") -> Column:
    return digest(seed, tag, *order)


def bound_contributions(df: DataFrame, unit: list[str] | str, max_rows: int, order: list[str], seed: int = 0) -> DataFrame:
    """At most ``max_rows`` rows per privacy unit; ``order`` names columns that identify a row."""
    return keep_smallest(df, _listed(unit), max_rows, order, seed)


def bound_partition_length(df: DataFrame, by: list[str] | str, max_rows: int, order: list[str], seed: int = 0) -> DataFrame:
    """At most ``max_rows`` rows per group."""
    return keep_smallest(df, _listed(by), max_rows, order, seed)


def bound_partitions(
    df: DataFrame, unit: list[str] | str, by: list[str], max_groups: int, max_rows: int, order: list[str], seed: int = 0
) -> DataFrame:
    """At most ``max_groups`` groups per unit and ``max_rows`` rows per unit and group."""
    unit = _listed(unit)
    per_pair = keep_smallest(df, [*unit, *by], max_rows, order, seed)
    rank = F.dense_rank().over(Window.partitionBy(*unit).orderBy(digest(seed, "group", *unit, *by), *by))
    return per_pair.withColumn("__rank", rank).filter(F.col("__rank") <= max_groups).drop("__rank")


def keep_smallest(
    df: DataFrame, by: list[str], n: int, order: list[str], seed: int = 0, map_side_limit: int = MAP_SIDE_LIMIT
) -> DataFrame:
    """The ``n`` rows of each group with the smallest hash of ``order``, exactly, for any group size.

    The thresholds of large limits are found and stored at once: one scan that counts and one that looks at the rows
    around the cut.
    """
    if n <= 0:
        raise InvalidQuery("a row limit must be positive")
    if not order:
        raise InvalidQuery("name the columns that identify a row")
    if by and n <= map_side_limit:
        rest = [c for c in df.columns if c not in order]  # so that a key that is not unique is cut alike whatever the layout
        ranked = Window.partitionBy(*by).orderBy(row_order(order, seed), *order, *rest)
        return df.withColumn("__rank", F.row_number().over(ranked)).filter(F.col("__rank") <= n).drop("__rank")

    keys = [f"__k{i}" for i in range(len(by))]
    tagged = df.withColumns({**{k: F.col(c) for k, c in zip(keys, by)}, "__hash": row_order(order, seed)})
    with Scratch(df.sparkSession) as held:
        cut = written(_thresholds(tagged, keys, n, held), "bound-thresholds")  # a row per group
    if by:
        found = cut.select(*[F.col(k).alias(f"{k}c") for k in keys], "__last", "__left", "__ties")
        matched = F.lit(True)
        for k in keys:
            matched = matched & F.col(k).eqNullSafe(F.col(f"{k}c"))
        marked = tagged.join(found, matched, "left")
    else:  # one group, so one threshold: constants instead of a join
        one = cut.first()
        if one is None:
            return df
        marked = tagged.withColumns({c: F.lit(one[c]) for c in ("__last", "__left", "__ties")})
    inside = F.col("__last").isNull() | (F.col("__hash") < F.col("__last"))
    if cut.filter("__left < __ties").isEmpty():
        return marked.filter(inside | (F.col("__hash") == F.col("__last"))).select(*df.columns)
    # rows that the order does not tell apart: equal ones are collapsed, then ranked by their other columns
    within = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order, *[c for c in df.columns if c not in order])
    edge = (
        marked.filter(F.col("__hash") == F.col("__last"))
        .groupBy(*keys, "__left", *df.columns)
        .agg(F.count("*").alias("__copies"))
        .withColumn("__before", F.sum("__copies").over(within) - F.col("__copies"))
        .withColumn("__take", F.least(F.col("__copies"), F.col("__left") - F.col("__before")))
    )
    return marked.filter(inside).select(*df.columns).unionByName(repeat_rows(edge.select(*df.columns, "__take"), "__take").select(*df.columns))


def _thresholds(tagged: DataFrame, keys: list[str], n: int, held: Scratch) -> DataFrame:
    """Per group of more than ``n`` rows: its n-th smallest hash, the rows of that hash that it keeps, and those it has.

    The hash is cut digit by digit.  The first digits are counted over all rows; the rows of the bucket that the cut falls
    into, one in 65,536, are all that is looked at again.
    """
    def cut_by(counts: DataFrame, part: str, before: str | None) -> DataFrame:
        """The row of each group in which the running count reaches ``n``; ``__upto`` counts the rows before it."""
        upto = F.sum("__n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
        start = upto - F.col("__n") if before is None else F.col(before) + upto - F.col("__n")
        return counts.withColumn("__start", start).filter((F.col("__start") < n) & (F.col("__start") + F.col("__n") >= n))

    def again(rows: DataFrame, part, found: DataFrame) -> DataFrame:
        """The rows of the bucket that the cut falls into, with the rows before it as ``__base``."""
        if not keys:
            one = found.first()
            return rows.filter(part == F.lit(one["__part"] if one else None)).withColumn("__base", F.lit(one["__start"] if one else 0))
        found = found.select(*[F.col(k).alias(f"{k}f") for k in keys], F.col("__part").alias("__cut"), F.col("__start").alias("__base"))
        same = part == F.col("__cut")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}f"))
        return rows.join(found, same)

    digits = F.substring("__hash", 1, BUCKET_HEX_DIGITS)
    first = cut_by(tagged.groupBy(*keys, digits.alias("__part")).agg(F.count("*").alias("__n")), "__part", None)
    hashes = again(tagged, digits, first).groupBy(*keys, "__hash", "__base").agg(F.count("*").alias("__n"))
    hashes = held(hashes, "bound-hashes")
    following = F.substring("__hash", 1, 2 * BUCKET_HEX_DIGITS)
    second = cut_by(hashes.groupBy(*keys, "__base", following.alias("__part")).agg(F.sum("__n").alias("__n")), "__part", "__base")
    last = again(hashes.drop("__base"), following, second).select(*keys, "__hash", "__n", "__base")
    found = cut_by(last, "__hash", "__base")
    return found.select(*keys, F.col("__hash").alias("__last"), (F.lit(n) - F.col("__start")).alias("__left"), F.col("__n").alias("__ties"))


def _listed(columns: list[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)
