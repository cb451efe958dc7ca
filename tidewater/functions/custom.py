"""Fields, currents and samplers that users bring: as Column functions, or as numpy functions over batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import noise


def sound(value: Column, z: Column) -> Column:
    """0 where a value is null or no finite number, and above the surface."""
    return F.when((z > 0) | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def field(f: Callable[[Column, Column, Column], Column]) -> Callable[[Column, Column, Column], Column]:
    """A user's scalar field f(x, y, z), a Column of Columns, with the guard.  It stays within the JVM, but what raises an
    error there (a division by 0 in ANSI mode, say) is the user's to avoid, by try_divide() and the like."""
    return lambda x, y, z: sound(f(x, y, z), z)


def current(f: Callable[[Column, Column, Column], tuple[Column, Column, Column]]) -> Callable[[Column, Column, Column], Column]:
    """A user's vector field, as a struct dx, dy, dz with the guard on each component."""
    return lambda x, y, z: F.struct(*(sound(c, z).alias(f"d{a}") for a, c in zip("xyz", f(x, y, z))))


def _evaluated(f: Callable, parts: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """f over a batch, parts x rows; if it fails there, point by point, with nan where it fails."""
    with np.errstate(all="ignore"):
        try:
            return np.broadcast_to(np.asarray(f(x, y, z), dtype=float).reshape(parts, -1), (parts, len(x))).copy()
        except Exception:
            out = np.full((parts, len(x)), np.nan)
            for k in range(len(x)):
                try:
                    out[:, k] = np.asarray(f(*(a[k : k + 1] for a in (x, y, z))), dtype=float).reshape(parts)
                except Exception:
                    continue
            return out


def _guarded(out: np.ndarray, z: np.ndarray) -> np.ndarray:
    out[:, ~np.isfinite(out).all(axis=0) | ~(z <= 0)] = 0.0
    return out


def batch_field(f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column, Column], Column]:
    """A user's scalar field over numpy arrays.  A batch that raises is tried point by point; points that raise, and values
    that are no finite numbers, give 0, and so does everything above the surface.  Null coordinates reach f as nan."""

    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        at = [c.to_numpy(dtype=float) for c in (x, y, z)]
        return pd.Series(_guarded(_evaluated(f, 1, *at), at[2])[0])

    return F.pandas_udf(run, "double")


def batch_current(f: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple]) -> Callable[[Column, Column, Column], Column]:
    """A user's vector field over numpy arrays, as a struct dx, dy, dz, under the same guard: a point with one bad component
    gives 0 for all three."""

    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        at = [c.to_numpy(dtype=float) for c in (x, y, z)]
        return pd.DataFrame(dict(zip(("dx", "dy", "dz"), _guarded(_evaluated(f, 3, *at), at[2]))))

    return F.pandas_udf(run, "dx double, dy double, dz double")


def action(key: Column, size: int, seed: int, sample: Callable[[Column, int], Column] | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    """`size` commands for a row, drawn by its key: sample(key, seed) for each, standard normal ones unless given, clipped to
    the bounds that are given."""
    draw = sample or noise.normal

    def clipped(c: Column) -> Column:
        c = c if low is None else F.greatest(c, low)
        return c if high is None else F.least(c, high)

    return F.array(*(clipped(draw(key, seed + 2 * k)) for k in range(size)))


def discrete_action(key: Column, size: int, seed: int, low: int, high: int) -> Column:
    """`size` whole numbers from low to high - 1, drawn by the row's key."""
    return F.array(*((low + F.floor(noise.uniform(key, seed + k) * (high - low))).cast("int") for k in range(size)))
