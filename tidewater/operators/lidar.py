"""Lidar returns: attenuation, drop-off and scan geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intensity(distance: Column, attenuation: float) -> Column:
    return F.exp(-attenuation * distance)


def kept(level: Column, draw_ray: Column, draw_point: Column, rate: float, limit: float, at_zero: float) -> Column:
    """General drop-off first; then dim points stay with a chance that grows with intensity."""
    slope = (1 - at_zero) / limit
    return (draw_ray >= rate) & ((level > limit) | (draw_point < slope * level + at_zero))


def elevation_fan(upper: float, lower: float, channels: int) -> Column:
    step = 0.0 if channels == 1 else (upper - lower) / (channels - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: upper - i * step)


def sweep_angle(start: Column, index: Column, step: float, field: float) -> Column:
    """The truncated remainder, centred."""
    return (start + index * step) % field - field / 2
