"""Arrays of constants in one call: a literal per element costs a round trip to the JVM each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_array(values: Sequence) -> Column:
    texts = [_number(v) for v in values]
    if not texts or None in texts or len({type(v) for v in values}) > 1:
        return F.array(*[F.lit(v) for v in values])
    return F.expr(f"array({', '.join(texts)})")


def constant_table(rows: Sequence[Sequence]) -> Column:
    """Array of arrays of doubles or of ints; empty rows are allowed."""
    texts = [[_number(v) for v in r] for r in rows]
    kind = "double" if any(isinstance(v, float) for r in rows for v in r) else "int"
    cells = ", ".join(f"array({', '.join(r)})" if r else f"cast(array() as array<{kind}>)" for r in texts)
    return F.expr(f"array({cells})")


def _number(value) -> str | None:
    """SQL text that parses to the very same number and type ``F.lit`` gives; None for other types."""
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return str(value) if -(2**31) < value < 2**31 else f"{value}L" if -(2**63) < value < 2**63 else None
    if isinstance(value, float) and math.isfinite(value):
        return f"{value!r}D"
    return None
