"""Post-processing of releases: joins, ordering, errors, intervals and tests.  Costs no budget."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.uniform import uniform, uniform_below

# Fixed value: normal quantile of a 95 % interval.
Z95 = 1.96


def merge_releases(releases: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Equi-join of releases on their keys; value columns carry the release's name as suffix."""
    out = None
    for name, df in releases.items():
        renamed = df.select(*by, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c not in by])
        out = renamed if out is None else out.join(renamed, by, "inner")
    return out


def top(df: DataFrame, by: list, n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def append_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of frames with the same columns in any order, one under the other; differing columns are refused."""
    for other in others:
        if sorted(other.columns) != sorted(first.columns):
            raise InvalidQuery(f"cannot append columns {sorted(other.columns)} to {sorted(first.columns)}")
        first = first.unionByName(other)
    return first


def rows_with(df: DataFrame, other: DataFrame, on: dict[str, str], found: bool = True) -> DataFrame:
    """Rows of ``df`` that have a partner in ``other`` (or, with ``found=False``, have none); null finds none."""
    keys = other.select(*[F.col(b).alias(f"__o{i}") for i, b in enumerate(on.values())])
    same = [F.col(a) == F.col(f"__o{i}") for i, a in enumerate(on)]
    return df.join(keys, same, "left_semi" if found else "left_anti")


def explode_col(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, F.explode(column))


def std_error(std: Column, n: Column) -> Column:
    return std / F.sqrt(n)


def std_error_of_variance(variance: Column, n: Column) -> Column:
    return F.sqrt(variance / n)


def confidence_interval(average: Column, error: Column, z: float = Z95) -> tuple[Column, Column]:
    return average - F.lit(z) * error, average + F.lit(z) * error


def t_tests(release: DataFrame, key: str, groups: list[str], mean: str, std: str, n: str, critical: float | None = None) -> DataFrame:
    """Pooled two-sample t statistic for every pair of the public groups.

    The pairs come from the public list, so each side is an equi-join with the release.
    """
    pairs = release.sparkSession.createDataFrame(list(combinations(groups, 2)), "group_a string, group_b string")
    left = release.select(F.col(key).alias("group_a"), *[F.col(c).alias(f"{r}a") for c, r in ((mean, "m"), (std, "s"), (n, "n"))])
    right = release.select(F.col(key).alias("group_b"), *[F.col(c).alias(f"{r}b") for c, r in ((mean, "m"), (std, "s"), (n, "n"))])
    na, nb = F.col("na"), F.col("nb")
    pooled = ((na - 1) * F.col("sa") * F.col("sa") + (nb - 1) * F.col("sb") * F.col("sb")) / (na + nb - 2)
    t = (F.col("ma") - F.col("mb")) / F.sqrt(pooled * (F.lit(1.0) / na + F.lit(1.0) / nb))
    out = pairs.join(left, "group_a").join(right, "group_b").select("group_a", "group_b", t.alias("t"), (na + nb - 2).alias("degrees"))
    return out if critical is None else out.withColumn("significant", F.abs("t") > F.lit(critical))


def slope_test(r2: Column, var_y: Column, var_x: Column, n: Column, slope: Column) -> tuple[Column, Column]:
    """Standard error of a regression slope and its t statistic."""
    error = F.sqrt((F.lit(1.0) - r2) * var_y / (var_x * (n - 2)))
    return error, slope / error


def recode(column: str | Column, mapping: dict, default: Column | None = None) -> Column:
    """Codes to labels; a code outside the map becomes ``default`` (null)."""
    if not mapping:
        raise InvalidQuery("recode needs a mapping")
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    c = F.col(column) if isinstance(column, str) else column
    found = table[c]
    return found if default is None else F.coalesce(found, default)


def quantile_fan(release: DataFrame, keys: list[str], low: str, mid: str, high: str, seed: int, draws: int = 50) -> DataFrame:
    """``draws`` values uniform in [low, mid] and as many in [mid, high], per released row."""
    spread = release.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * draws - 1))).alias("draw"))
    u = uniform(seed, "fan", *keys, index=F.col("draw"))
    lower = F.col("draw") < draws
    value = F.when(lower, F.col(low) + u * (F.col(mid) - F.col(low))).otherwise(F.col(mid) + u * (F.col(high) - F.col(mid)))
    return spread.select(*keys, "draw", value.alias("value"))


def split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test parts, decided per row by a hash of its key: no shuffle, stable under retry."""
    if not 0.0 < test_size < 1.0:
        raise InvalidQuery("test_size must lie in (0, 1)")
    is_test = uniform_below(test_size, seed, "split", *key)
    return df.filter(~is_test), df.filter(is_test)
