"""Task rewards and event detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def location(distance: Column, goal: float, negative: bool = False, has_terminal: bool = True) -> tuple[Column, Column]:
    inside = distance < goal
    return F.when(inside, -1 if negative else 1).otherwise(0), inside if has_terminal else F.lit(False)


def follow(distance: Column, least: float, most_score: float, seen: Column | None = None) -> Column:
    """Grows to most_score as the distance shrinks to 0; 0 beyond `least` or out of sight."""
    near = distance < least if seen is None else seen & (distance < least)
    return F.when(near, most_score * (least - distance) / least).otherwise(0.0)


def avoid(distance: Column, least: float, most_score: float, seen: Column | None = None) -> Column:
    """Falls to 0 as the distance shrinks to 0; 100 when clear."""
    near = distance < least if seen is None else seen & (distance < least)
    return F.when(near, most_score * distance / least).otherwise(100.0)


def shock(acceleration: Column, limit: float, abused: Column | None = None) -> Column:
    """1 where the acceleration passes a limit (-1: none) or the agent is abused."""
    over = F.lit(False) if limit == -1 else F.abs(acceleration) > limit
    return (over if abused is None else abused | over).cast("int")


def cup_game(df: DataFrame, by: str, order: list[str], ball: Column, right: Column, wrong: Column) -> DataFrame:
    """by, order, reward and terminal: 2 for touching the ball, -1 for a wrong cup, which bars all else, and 1 for the right cup,
    once a run.  The ball and a wrong cup end a run, and it stays ended.  Null conditions are false."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ball, right, wrong = (F.coalesce(c, F.lit(False)) for c in (ball, right, wrong))
    rows = df.select(by, *order, (ball & ~wrong).alias("__ball"), (right & ~wrong & ~ball).alias("__right"), wrong.alias("__wrong"))
    first = F.sum(F.col("__right").cast("int")).over(upto) == 1
    reward = F.when(F.col("__ball"), 2).when(F.col("__right") & first, 1).when(F.col("__wrong"), -1).otherwise(0)
    return rows.select(by, *order, reward.alias("reward"), F.max(F.col("__ball") | F.col("__wrong")).over(upto).alias("terminal"))
