"""Noise on aggregated rows.

Two sources.  ``Secure`` draws from operating-system entropy inside ``mapInPandas`` on the already
aggregated (small) table; its output must be written once, see ``sources.release``.  ``Seeded`` is a
column expression over ``uniform`` for rehearsals and tests, refused unless insecurity is accepted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import MAX_EMAX, MIN_EMIN, Decimal, localcontext
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.errors import InvalidQuery
from hushframe.functions.uniform import uniform

MECHANISMS = ("laplace", "gaussian", "gumbel", "discrete_laplace")


@dataclass(frozen=True)
class Secure:
    """Operating-system entropy; never repeatable."""


@dataclass(frozen=True)
class Seeded:
    """Repeatable draws for dummy tables and tests."""

    seed: int
    allow_insecure: bool = False

    def __post_init__(self):
        if not self.allow_insecure:
            raise InvalidQuery("seeded noise can be subtracted again; pass allow_insecure=True for tests only")


@dataclass(frozen=True)
class Noise:
    """Noise for one column: ``scale`` is a number or the name of a column holding one."""

    column: str
    mechanism: str
    scale: float | str
    out: str | None = None

    def __post_init__(self):
        if self.mechanism not in MECHANISMS:
            raise InvalidQuery(f"unknown mechanism {self.mechanism!r}")
        if not isinstance(self.scale, str) and not self.scale > 0:
            raise InvalidQuery("noise scale must be positive")

    @property
    def target(self) -> str:
        return self.out or self.column


def laplace_from(u: Column, scale: Column) -> Column:
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def gaussian_from(u1: Column, u2: Column, scale: Column) -> Column:
    return scale * F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * np.pi) * u2)


def gumbel_from(u: Column, scale: Column) -> Column:
    return -scale * F.ln(-F.ln(u))


def geometric_from(u: Column, scale: Column) -> Column:
    return F.floor(-scale * F.ln(u)).cast("double")


def seeded_draw(mechanism: str, scale: Column, seed: int, tag: str, keys: list) -> Column:
    u0, u1 = (uniform(seed, tag, *keys, index=i) for i in (0, 1))
    if mechanism == "laplace":
        return laplace_from(u0, scale)
    if mechanism == "gaussian":
        return gaussian_from(u0, u1, scale)
    if mechanism == "gumbel":
        return gumbel_from(u0, scale)
    return geometric_from(u0, scale) - geometric_from(u1, scale)


def _entropy_uniform(n: int) -> np.ndarray:
    bits = np.frombuffer(os.urandom(8 * n), dtype=np.uint64) >> np.uint64(12)
    return (bits.astype(np.float64) + 0.5) / 2.0**52


WORDS = 4  # 64-bit words to which a probability is known


@cache
def bit_chances(scale: Fraction) -> tuple[tuple[int, ...], ...]:
    """Chance of each binary digit of a geometric variable with ratio exp(-1 / scale), as words of its binary expansion.

    The digits of a geometric variable are independent: digit j is one with chance 1 / (1 + exp(2^j / scale)).  Digits
    whose chance is below the last word's last bit are left out.
    """
    out, j = [], 0
    with localcontext() as context:
        context.prec, context.Emax, context.Emin = 120, MAX_EMAX, MIN_EMIN
        while Fraction(2**j) / scale < 64 * WORDS:
            x = Decimal(2**j * scale.denominator) / Decimal(scale.numerator)
            digits = int(Decimal(2) ** (64 * WORDS) / (1 + x.exp()))
            out.append(tuple(digits >> 64 * (WORDS - 1 - k) & (2**64 - 1) for k in range(WORDS)))
            j += 1
    if j > 62:
        raise InvalidQuery("the noise scale is too large for whole numbers")
    return tuple(out)


def geometric_draws(scale: Fraction, n: int) -> np.ndarray:
    """Whole numbers with chances proportional to exp(-x / scale): random words against known ones, digit by digit.

    Only integers are compared.  A word that equals the known one leaves the digit open, and the next word decides.
    """
    total = np.zeros(n, np.int64)
    for j, chance in enumerate(bit_chances(scale)):
        open_ = np.arange(n)
        for word in chance:
            drawn = np.frombuffer(os.urandom(8 * len(open_)), np.uint64)
            total[open_[drawn < np.uint64(word)]] += 1 << j
            open_ = open_[drawn == np.uint64(word)]
            if not len(open_):
                break
    return total


def discrete_laplace_draws(scale: float, n: int) -> np.ndarray:
    """Whole numbers with chances proportional to exp(-|x| / scale), as the difference of two geometric ones."""
    exact = Fraction(float(scale))
    return geometric_draws(exact, n) - geometric_draws(exact, n)


def secure_draws(mechanism: str, scale: np.ndarray) -> np.ndarray:
    n = len(scale)
    if mechanism == "laplace":
        centred = _entropy_uniform(n) - 0.5
        return -scale * np.sign(centred) * np.log1p(-2.0 * np.abs(centred))
    if mechanism == "gaussian":
        return scale * np.sqrt(-2.0 * np.log(_entropy_uniform(n))) * np.cos(2.0 * np.pi * _entropy_uniform(n))
    if mechanism == "gumbel":
        return -scale * np.log(-np.log(_entropy_uniform(n)))
    out = np.empty(n)
    for s in np.unique(scale):  # rows of one release share a few scales
        same = scale == s
        out[same] = discrete_laplace_draws(s, int(same.sum()))
    return out


def add_noise(df: DataFrame, noises: list[Noise], keys: list[str], mode: Secure | Seeded, tag: str) -> DataFrame:
    """Add an independent draw to every named column of every row of an aggregated table.

    ``keys`` identify a row (the group), so that seeded draws do not repeat across rows; every element of
    a vector-valued release is its own column or its own row and gets its own draw.
    """
    if isinstance(mode, Seeded):
        cols = {}
        for noise in noises:
            scale = F.col(noise.scale) if isinstance(noise.scale, str) else F.lit(float(noise.scale))
            draw = seeded_draw(noise.mechanism, scale, mode.seed, f"{tag}|{noise.target}", keys)
            cols[noise.target] = F.col(noise.column).cast("double") + draw
        return df.withColumns(cols)

    targets = {n.target for n in noises}
    schema = T.StructType(
        [f if f.name not in targets else T.StructField(f.name, T.DoubleType()) for f in df.schema.fields]
        + [T.StructField(n.target, T.DoubleType()) for n in noises if n.target not in df.columns]
    )
    order = [f.name for f in schema.fields]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fresh = {}
            for noise in noises:
                scale = batch[noise.scale] if isinstance(noise.scale, str) else np.full(len(batch), noise.scale)
                values = batch[noise.column].to_numpy(dtype=float)
                fresh[noise.target] = values + secure_draws(noise.mechanism, np.asarray(scale, dtype=float))
            yield batch.assign(**fresh)[order]

    return df.mapInPandas(draw, schema)


def add_laplace(df, columns, scale, keys, mode, tag="laplace") -> DataFrame:
    return add_noise(df, [Noise(c, "laplace", scale) for c in _listed(columns)], keys, mode, tag)


def add_gaussian(df, columns, sigma, keys, mode, tag="gaussian") -> DataFrame:
    return add_noise(df, [Noise(c, "gaussian", sigma) for c in _listed(columns)], keys, mode, tag)


def add_discrete_laplace(df, columns, scale, keys, mode, tag="discrete") -> DataFrame:
    """Integer-valued noise for counts: no floating-point leak in the low bits."""
    return add_noise(df, [Noise(c, "discrete_laplace", scale) for c in _listed(columns)], keys, mode, tag)


def select_noisy_max(df, by, candidate, score, temperature, mode, tag="noisy_max") -> DataFrame:
    """Exponential mechanism over a candidate table: the candidate of the highest score plus Gumbel noise."""
    noisy = add_noise(df, [Noise(score, "gumbel", temperature, "__noisy")], [*by, candidate], mode, tag)
    best = F.max_by(candidate, F.struct("__noisy", candidate)).alias(candidate)
    return noisy.groupBy(*by).agg(best) if by else noisy.agg(best)


def threshold(df: DataFrame, noisy: str, tau: float) -> DataFrame:
    """Keep groups whose noisy size reaches ``tau``; applied above the noise, so keys were fixed before."""
    return df.filter(F.col(noisy) >= F.lit(float(tau)))


def _listed(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)
