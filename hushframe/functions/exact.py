"""Order-independent sums.

A floating-point sum changes with the order of its terms, which both breaks reproducibility and makes the
true sensitivity larger than the declared one.  Values with a public bound are therefore put on a decimal
grid and added as longs, in two halves of 22 bits so that about 10^12 rows fit without overflow (an
overflow would raise under ANSI mode, never wrap).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_BITS = 22
HALF = 1 << HALF_BITS
MAX_DIGITS = 9


def grid_digits(bound: float) -> int:
    """Decimal digits kept for values of absolute size up to ``bound``."""
    if bound <= 0:
        return MAX_DIGITS
    return min(MAX_DIGITS, math.floor(math.log10(2 ** (2 * HALF_BITS - 1) / bound)))


def on_grid(value: Column, bound: float) -> Column:
    """Nearest grid point as a long."""
    factor = 10.0 ** grid_digits(bound)
    return F.floor(value.cast("double") * F.lit(factor) + F.lit(0.5)).cast("bigint")


def exact_sum(value: Column, bound: float) -> Column:
    """Aggregate: sum of bounded values, the same for every order of rows; 0 for no rows."""
    grid = on_grid(value, bound)
    high = F.coalesce(F.sum(F.shiftright(grid, HALF_BITS)), F.lit(0)).cast("decimal(24,0)")
    low = F.coalesce(F.sum(grid.bitwiseAND(F.lit(HALF - 1))), F.lit(0)).cast("decimal(24,0)")
    total = (high * F.lit(HALF).cast("decimal(8,0)") + low).cast("double")
    return total / F.lit(10.0 ** grid_digits(bound))
