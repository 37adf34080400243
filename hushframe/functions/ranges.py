"""Position of a value among sorted public edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.literals import constant_array

TREE_EDGES = 31


def edges_at_or_below(value: Column, edges: Sequence) -> Column:
    """How many of the sorted edges are <= value; null for null.

    Few edges become a balanced CASE expression.  Many would generate a method too long to compile, so a
    short CASE picks a block of about sqrt(n) edges and only that block is counted through.
    """
    ordered = list(edges)
    if len(ordered) <= TREE_EDGES:
        return F.when(value.isNotNull(), _tree(value, ordered, 0, len(ordered)))
    width = math.isqrt(len(ordered)) + 1
    fences = ordered[width - 1::width]
    blocks = [ordered[i * width:(i + 1) * width - 1] for i in range(len(fences) + 1)]
    table = F.array(*[constant_array(b) if b else F.array().cast(_array_type(ordered[0])) for b in blocks])
    fence = _tree(value, fences, 0, len(fences))
    inside = F.size(F.filter(F.element_at(table, fence + 1), lambda e: e <= value))
    return F.when(value.isNotNull(), fence * width + inside)


def edge_position(value: Column, edges: Sequence[float]) -> Column:
    """Odd ``2i+1`` when the number equals ``edges[i]``, else even ``2i`` with i edges below it.

    Each edge is listed with the next larger double, so that only equal values fall between the two.
    """
    doubled = [x for e in edges for x in (float(e), math.nextafter(float(e), math.inf))]
    return edges_at_or_below(value.cast("double"), doubled)


def _tree(value: Column, edges: list, low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value < F.lit(edges[mid]), _tree(value, edges, low, mid)).otherwise(_tree(value, edges, mid + 1, high))


def _array_type(sample) -> str:
    return "array<double>" if isinstance(sample, float) else "array<bigint>" if isinstance(sample, int) else "array<string>"
