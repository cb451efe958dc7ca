"""Ray marching through voxels and clusters of neighbouring voxels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hit(rays: DataFrame, voxels: DataFrame, ray: str, cell: float, step: float, steps: int) -> DataFrame:
    """For each ray (x, y, z, dx, dy, dz) the first occupied voxel (i, j, k) that its steps meet, and at which step.

    Steps become rows, an equi join finds the occupied ones, and a map-side minimum keeps the first.
    """
    marched = rays.select(ray, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), *("x", "y", "z", "dx", "dy", "dz"))
    at = [F.floor((F.col(c) + F.col(f"d{c}") * F.col("step") * step) / cell).cast("int").alias(i) for c, i in zip("xyz", "ijk")]
    met = marched.select(ray, "step", *at).join(voxels.select("i", "j", "k").distinct(), ["i", "j", "k"])
    return met.groupBy(ray).agg(F.min(F.struct("step", "i", "j", "k")).alias("hit")).select(ray, "hit.*")


def clusters(voxels: DataFrame, by: str, size: int, alike: float = 0.965) -> DataFrame:
    """Seeds of greedy clusters: from the lowest index on, each free voxel takes the free ones within `size` in every
    index whose normals (nx, ny, nz) point the same way.  One ping's voxels go through one task in turn."""
    kind = voxels.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j", "k"])
        at = {tuple(r): n for n, r in enumerate(pdf[["i", "j", "k"]].to_numpy().tolist())}
        normal, seed = pdf[["nx", "ny", "nz"]].to_numpy(float), np.full(len(pdf), -1)
        reach = range(-size, size + 1)
        for (i, j, k), n in at.items():
            if seed[n] < 0:
                seed[n] = n
                for m in (at.get((i + a, j + b, k + c)) for a in reach for b in reach for c in reach):
                    if m is not None and seed[m] < 0 and normal[m] @ normal[n] > alike:
                        seed[m] = n
        first = pdf[["i", "j", "k"]].to_numpy()[seed]
        return pdf[[by, "i", "j", "k"]].assign(si=first[:, 0], sj=first[:, 1], sk=first[:, 2])

    columns = [by, "i", "j", "k", "nx", "ny", "nz"]
    once = voxels.select(*columns).dropDuplicates([by, "i", "j", "k"])
    return once.groupBy(by).applyInPandas(run, f"{by} {kind}, i int, j int, k int, si int, sj int, sk int")
