"""Ocean fields, cycles and decoders as column expressions.  Positions are metres, z up."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Cluster = tuple[float, float, float, float, float]  # x, y, z, strength, falloff


def cluster_influence(x: Column, y: Column, z: Column, clusters: Sequence[Cluster]) -> Column:
    """Sum of strength * exp(-distance / falloff); clusters without a positive falloff do not count."""
    total = F.lit(0.0)
    for cx, cy, cz, strength, falloff in clusters:
        if falloff > 0:
            total = total + strength * F.exp(-F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) / falloff)
    return total


def _layered(x, y, z, surface, deep, centre, thickness, clusters) -> Column:
    depth = F.greatest(-z, F.lit(0.0))
    base = surface + (deep - surface) / (1 + F.exp(-(depth - centre) / thickness))
    return F.when(z > 0, 0.0).otherwise(base + cluster_influence(x, y, z, clusters))


def temperature(x, y, z, clusters=(), surface=23.0, deep=4.0, thermocline=100.0, thickness=20.0) -> Column:
    return _layered(x, y, z, surface, deep, thermocline, thickness, clusters)


def salinity(x, y, z, clusters=(), surface=33.0, deep=34.5, halocline=100.0, thickness=20.0) -> Column:
    return _layered(x, y, z, surface, deep, halocline, thickness, clusters)


def biomass(x, y, z, clusters=(), surface=1.2, most=1.0, peak=50.0, width=25.0, floor=0.1, photic=200.0, sharpness=20.0) -> Column:
    """A Gaussian layer at `peak`, handed over to a deep constant by a sigmoid at `photic`."""
    depth = F.greatest(-z, F.lit(1e-3))
    layer = surface + (most - surface) * F.exp(-(depth - peak) * (depth - peak) / (2 * width * width))
    gate = 1 / (1 + F.exp((depth - photic) / sharpness))
    return F.when(z > 0, 0.0).otherwise(layer * gate + floor * (1 - gate) + cluster_influence(x, y, z, clusters))


def bst(biomass_: Column, salinity_: Column, temperature_: Column) -> Column:
    """The three fields together; what is missing or not finite falls back to 0, 35 and 20."""
    sound = lambda c, other: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(other)).otherwise(c)
    return F.struct(sound(biomass_, 0.0).alias("biomass"), sound(salinity_, 35.0).alias("salinity"), sound(temperature_, 20.0).alias("temperature"))


def tide_height(ticks: Column, amplitude: float, frequency: float) -> Column:
    return amplitude * F.sin(2 * pi / frequency * ticks)


def time_of_day(ticks: Column, frequency: float) -> Column:
    return F.pmod(ticks, F.lit(frequency)) / frequency * 24 if frequency else F.lit(0.0)


def decoded_depth(red: Column, green: Column, blue: Column) -> Column:
    """Metres from a 24-bit depth pixel."""
    return (red + green * 256 + blue * 65536) / float(2**24 - 1) * 1000
