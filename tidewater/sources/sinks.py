"""Writers: logs, one folder for each ping, prefixed results, and typed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).csv(path, header=True)


def by_ping(df: DataFrame, path: str, ping: str) -> None:
    """One folder for each ping that has points."""
    df.repartition(ping).write.mode("overwrite").partitionBy(ping).csv(path, header=True)


def predictions(df: DataFrame, path: str, name: str, distance: str, under: float) -> str:
    """Matches closer than a distance, under a name with the prefix predicted_."""
    target = f"{path.rstrip('/')}/predicted_{name}"
    df.where(F.col(distance) < under).write.mode("overwrite").csv(target, header=True)
    return target


def messages(df: DataFrame, channel: str, tick: str, ticks_per_second: int) -> DataFrame:
    """Rows as (channel, timestamp in ms, payload as JSON), ready for a message sink."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != tick]))
    return df.select(F.lit(channel).alias("channel"), F.floor(1000 * F.col(tick) / ticks_per_second).cast("long").alias("timestamp"), body.alias("payload"))


def missing_materials(rows: DataFrame, materials: DataFrame, name: str) -> DataFrame:
    """Names that the material table lacks, to be added to it."""
    return rows.select(F.col(name).alias("material")).where("material IS NOT NULL").distinct().join(materials.select("material"), "material", "left_anti")


def add_missing_materials(rows: DataFrame, materials_path: str, name: str, density: float, sound_speed: float) -> None:
    """Appends a default row to the material files for every name that they lack, so that each is looked up once in vain."""
    from tidewater.sources.readers import materials

    new = missing_materials(rows, materials(rows.sparkSession, materials_path), name)
    new.select("material", F.lit(density).alias("density"), F.lit(sound_speed).alias("sound_speed")).write.mode("append").csv(materials_path, header=True)
