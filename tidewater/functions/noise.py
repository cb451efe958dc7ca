"""Noise that depends on a row's key and a seed only, so that any engine and partitioning draws the same."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1), from the first 32 bits of md5(key:seed)."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(key: Column, seed: int) -> Column:
    """Box-Muller over two uniforms."""
    return F.sqrt(-2 * F.ln(1 - uniform(key, seed))) * F.cos(2 * pi * uniform(key, seed + 1))


def rayleigh(key: Column, seed: int, sigma: float = 1.0) -> Column:
    a, b = normal(key, seed), normal(key, seed + 2)
    return sigma * F.sqrt(a * a + b * b)


def exponential(key: Column, seed: int, scale: float = 1.0) -> Column:
    return -scale * F.ln(1 - uniform(key, seed))


def correlated(key: Column, seed: int, factor: list[list[float]]) -> list[Column]:
    """L N(0, I) for a lower-triangular factor L of the covariance."""
    draws = [normal(key, seed + 2 * k) for k in range(len(factor))]
    return [sum((row[k] * draws[k] for k in range(1, len(row))), row[0] * draws[0]) for row in factor]


def factor_of(spread: float | list[float] | list[list[float]], size: int) -> list[list[float]]:
    """The lower-triangular factor for correlated(), from one deviation, one for each axis, or a covariance matrix."""
    import numpy as np

    given = np.asarray(spread, dtype=float)
    return (np.linalg.cholesky(given) if given.ndim == 2 else np.diag(np.broadcast_to(given, size))).tolist()


def exclusive(config: Column, pairs: list[tuple[str, str]]) -> Column:
    """The first pair of keys, as "a, b", of which a settings map holds both; null where none is set twice."""
    out = F.lit(None).cast("string")
    for a, b in reversed(pairs):
        both = F.map_contains_key(config, a) & F.map_contains_key(config, b)
        out = F.when(both, F.lit(f"{a}, {b}")).otherwise(out)
    return out
