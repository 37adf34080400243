"""Deterministic uniforms keyed by content, as column expressions.

A draw depends only on (seed, tag, key values, index), never on partitioning, so the same release is
produced by any cluster layout and by any engine with md5.  Used for dummy tables, splits, ordering and
the seeded noise mode; not a source of secrecy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.ranges import edges_at_or_below

NULL_KEY = "\\N"


def key_text(*keys: str | Column) -> list[Column]:
    """Keys as text, a null told apart from an absent key."""
    return [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit(NULL_KEY)) for k in keys]


def digest(seed: int | str, tag: str, *keys: str | Column, index: int | str | Column = 0) -> Column:
    """md5 text over seed, tag, keys and index: a stable random order for rows."""
    last = index.cast("string") if isinstance(index, Column) else F.lit(str(index))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *key_text(*keys), last))


def hash52(seed: int | str, tag: str, *keys: str | Column, index: int | str | Column = 0) -> Column:
    """First 52 bits of the digest as a long."""
    return F.conv(F.substring(digest(seed, tag, *keys, index=index), 1, 13), 16, 10).cast("bigint")


def hex_mark(share: float) -> str:
    """The 13 hex digits below which a digest's uniform is smaller than ``share``."""
    return f"{min(max(math.ceil(share * 2**52 - 0.5), 0), 2**52 - 1):013x}"


def uniform_below(share: float, seed: int | str, tag: str, *keys: str | Column) -> Column:
    """``uniform(...) < share`` by comparing digits as text, without turning them into a number per row."""
    return F.substring(digest(seed, tag, *keys), 1, 13) < F.lit(hex_mark(share))


def uniform_slot(slots: int, seed: int | str, tag: str, *keys: str | Column) -> Column:
    """``floor(uniform(...) * slots)``, likewise by text comparisons."""
    marks = [hex_mark(i / slots) for i in range(1, slots)]
    return edges_at_or_below(F.substring(digest(seed, tag, *keys), 1, 13), marks)


def uniform(seed: int | str, tag: str, *keys: str | Column, index: int | str | Column = 0) -> Column:
    """Uniform on the open interval (0, 1)."""
    return (hash52(seed, tag, *keys, index=index).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
