"""Cubes and time grids that are made up, for tests of scale; draws are keyed, so every run and partitioning makes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.functions.scalars import clock_of, uniform


def cube(tiles: DataFrame, services: DataFrame, slots: DataFrame, below: int = 100, seed: str = "0") -> DataFrame:
    """A dense cube of whole values from 0 to ``below`` - 1. Services and slots are labels, so their tables are broadcast; tiles may be any
    number."""
    grid = tiles.crossJoin(F.broadcast(services)).crossJoin(F.broadcast(slots))
    keys = [c for t in (tiles, services, slots) for c in t.columns]
    return grid.withColumn("value", F.floor(below * uniform(seed, *map(F.col, keys))).cast("double"))


def moments(ends: DataFrame, first: str, last: str, minutes: int) -> DataFrame:
    """For each row's span of days, ends included, every moment at that distance: day, slot and ``moment`` as text."""
    days = ends.withColumn("day", F.explode(F.sequence(first, last)))
    grid = days.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(24 * 60 // minutes - 1))))
    return grid.withColumn("moment", F.concat(F.col("day").cast("string"), F.lit(" "), clock_of(F.col("slot") * minutes * 60)))
