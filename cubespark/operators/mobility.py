"""Commuting and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAR_METRES_AN_HOUR = 30_000
DEFAULT_SECONDS, DEFAULT_METRES = 5 * 60, 1000


def commute_duration(flows: DataFrame, trips: DataFrame, modes: DataFrame, least: float = 0.005) -> DataFrame:
    """(home, mean_seconds): mean commuting time of a home's workers.

    Flows (home, work, count) above a share of ``least`` of their home's total count; trips (home, work, duration_seconds,
    distance_meters) are public transport, with defaults where there is none; cars, a share of car_share of the work
    place's and home's workers in modes (home, car_share), go 30 km/h. The divisor is the total with the small flows.
    """
    total = flows.groupBy("home").agg(F.sum("count").alias("_total"))
    main = flows.join(total, "home").where(F.col("count") / F.col("_total") > least)
    joined = main.join(trips, ["home", "work"], "left").join(modes, "home", "left")
    joined = joined.na.fill({"duration_seconds": DEFAULT_SECONDS, "distance_meters": DEFAULT_METRES})
    n, car = F.col("count"), F.col("car_share")
    seconds = n * (1 - car) * F.col("duration_seconds") + n * car * (F.col("distance_meters") / CAR_METRES_AN_HOUR * 3600)
    return joined.groupBy("home", "_total").agg(F.sum(seconds).alias("_s")).select("home", F.try_divide("_s", "_total").alias("mean_seconds"))


def vote_share(votes: DataFrame, parties: list[str], radius: float = 1200.0) -> DataFrame:
    """(unit, vote_share): summed shares of the listed parties, over units whose voting area has a radius below ``radius``.

    Contract chosen here: votes (unit, party, pct, radius)."""
    near = votes.where((F.col("radius") < radius) & F.col("party").isin(parties))
    return near.groupBy("unit").agg(F.sum("pct").alias("vote_share"))
