"""Sonar profiles: arrays of intensities by range bin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axis(low: float, high: float, bins: int, index: Column) -> Column:
    """The index-th of `bins` evenly spaced values, both ends included."""
    return low + index * ((high - low) / (bins - 1))


def strongest_bin(profile: Column) -> Column:
    """Index from 0 of the first maximum; null for a null or empty profile."""
    return F.array_position(profile, F.array_max(profile)).cast("int") - 1


def normalised(profile: Column) -> Column:
    """(v - min) / (max - min); zeros where all are equal."""
    low, high = F.array_min(profile), F.array_max(profile)
    return F.transform(profile, lambda v: F.when(high > low, (v.cast("double") - low) / (high.cast("double") - low)).otherwise(0.0))


def quantised(profile: Column) -> Column:
    return F.transform(profile, lambda v: F.floor(v * 255).cast("int"))
