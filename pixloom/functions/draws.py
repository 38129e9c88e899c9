"""Distributions, and draws keyed by (seed, stream, id).

A draw is a hash of its key, never of a row's partition or order, so any
executor that repeats a task draws the same.  Python, Spark and SQL engines with
md5 agree bit by bit.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: int, stream: str, key) -> float:
    """In [0, 1)."""
    return int(hashlib.md5(f"{seed}:{stream}:{key}".encode()).hexdigest()[:8], 16) / 2**32


def unit_column(seed: int, stream: str, key: str = "image_id") -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{stream}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def unit_sql(seed: int, stream: str, key: str = "image_id") -> str:
    """For DuckDB."""
    return f"(('0x' || substr(md5('{seed}:{stream}:' || {key}::varchar), 1, 8))::bigint / 4294967296.0::double)"


class Distribution:
    """A parameter that is drawn for each image (or clip)."""

    two = True  # whether `at` looks at its second number

    def at(self, u: float, u2: float) -> float:
        raise NotImplementedError

    def column(self, u: Column, u2: Column) -> Column:
        raise NotImplementedError

    def draw(self, seed: int, stream: str, key) -> float:
        return self.at(unit(seed, stream, key), unit(seed, f"{stream}/2", key) if self.two else 0.0)

    def integer(self, seed: int, stream: str, key) -> int:
        """Floats are rounded, halves away from zero."""
        x = self.draw(seed, stream, key)
        return int(math.copysign(math.floor(abs(x) + 0.5), x))

    def drawn(self, seed: int, stream: str, key: str = "image_id") -> Column:
        return self.column(unit_column(seed, stream, key), unit_column(seed, f"{stream}/2", key))


@dataclass(frozen=True)
class Constant(Distribution):
    value: float

    def at(self, u, u2):
        return self.value

    def draw(self, seed, stream, key):
        return self.value

    def column(self, u, u2):
        return F.lit(self.value)

    def integer(self, seed, stream, key):
        return int(self.value)  # constants are truncated


@dataclass(frozen=True)
class Uniform(Distribution):
    two = False
    min: float
    max: float

    def __post_init__(self):
        if not self.min < self.max:
            raise ValueError("min must be less than max")

    def at(self, u, u2):
        return self.min + (self.max - self.min) * u

    def column(self, u, u2):
        return F.lit(self.min) + F.lit(self.max - self.min) * u


@dataclass(frozen=True)
class UniformInt(Distribution):
    two = False
    min: int
    max: int

    def at(self, u, u2):
        return self.min + math.floor(u * (self.max - self.min + 1))

    def column(self, u, u2):
        return F.lit(self.min) + F.floor(u * (self.max - self.min + 1))


@dataclass(frozen=True)
class Bernoulli(Distribution):
    two = False
    p: float

    def at(self, u, u2):
        return float(u < self.p)

    def column(self, u, u2):
        return (u < self.p).cast("double")


@dataclass(frozen=True)
class Normal(Distribution):
    mu: float
    sigma: float

    def at(self, u, u2):
        return self.mu + self.sigma * math.sqrt(-2 * math.log(1 - u)) * math.cos(2 * math.pi * u2)

    def column(self, u, u2):
        return F.lit(self.mu) + F.lit(self.sigma) * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * u2)


def distribution(x) -> Distribution:
    """A number is Constant, a pair (tuple or list) Uniform."""
    if isinstance(x, Distribution):
        return x
    if isinstance(x, tuple | list) and len(x) == 2:
        return Uniform(*x)
    return Constant(x)


def chance(p) -> Distribution:
    """An activation: a number is the probability itself."""
    if p is None:
        return Constant(1.0)
    return p if isinstance(p, Bernoulli) else Bernoulli(p.value if isinstance(p, Constant) else float(p))


def pick(u: float, weights: list[float]) -> int:
    """The first branch whose cumulative weight reaches u's share of the sum."""
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    roll, total = u * sum(weights), 0.0
    for k, w in enumerate(weights):
        total += w
        if roll <= total and w > 0:
            return k
    return max(k for k, w in enumerate(weights) if w > 0)


def some(seed: int, stream: str, key, n: int, k: int) -> list[int]:
    """k of n branches (at least one) by the order of their own draws."""
    return sorted(range(n), key=lambda i: (unit(seed, f"{stream}/{i}", key), i))[: max(1, min(k, n))]
