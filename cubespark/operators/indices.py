"""Night index, revealed comparative advantage, and the service space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.functions.scalars import log10_plus_one, slot_to_clock
from cubespark.operators.cube import cumulative, dense, mean_over, share
from cubespark.operators.ordered import join_on
from cubespark.sources.store import cut_lineage


def night_index(cube: DataFrame, unit: str, scope: tuple[str, ...] = ("city",), value: str = "value") -> DataFrame:
    """(scope, unit, night_index): how much later than the scope's average unit this one is active, in slots.

    The index is the sum over slots of the mean cumulative distribution less the unit's own. With slots 0..T-1 the sum of a
    unit's cumulative distribution is T less its expected slot, so the index is the expected slot less its mean: two sums, no
    dense grid, no window over time. A unit with a total of zero is left out of the mean and has the index 0.
    """
    sums = cube.groupBy(*scope, unit).agg(F.sum(F.col(value) * F.col("slot")).alias("_vs"), F.sum(value).alias("_v"))
    expected = sums.withColumn("_e", F.try_divide("_vs", "_v"))
    # The means are grouped and joined back: a window over a scope would put all of its units into one task.
    joined = join_on(expected, expected.groupBy(*scope).agg(F.avg("_e").alias("_mean")), [*scope])
    return joined.select(*scope, unit, F.coalesce(F.col("_e") - F.col("_mean"), F.lit(0.0)).alias("night_index"))


def night_index_by_cdf(cube: DataFrame, unit: str, scope: tuple[str, ...] = ("city",), value: str = "value") -> DataFrame:
    """The same from cumulative distributions on the dense grid: the definition, for comparison."""
    sums = cube.groupBy(*scope, unit, "slot").agg(F.sum(value).alias(value))
    grid = dense(sums, sums, *scope, unit, value=value)
    cdf = cumulative(share(grid, *scope, unit, value=value), *scope, unit)
    means = cdf.groupBy(*scope, "slot").agg(F.avg("cdf").alias("_mean"))
    gap = F.col("_mean") - F.col("cdf")
    return join_on(cdf, means, [*scope, "slot"]).withColumn("_gap", gap).groupBy(*scope, unit).agg(F.coalesce(F.sum("_gap"), F.lit(0.0)).alias("night_index"))


def deviation_from_mean_cdf(probability: DataFrame, unit: str) -> DataFrame:
    """(unit, deviation): sum over slots of a unit's cumulative probability less the mean one; p as given, on a dense grid."""
    cdf = cumulative(probability, unit, value="p")
    means = cdf.groupBy("slot").agg(F.avg("cdf").alias("_mean"))
    return join_on(cdf, means, ["slot"]).withColumn("_gap", F.col("cdf") - F.col("_mean")).groupBy(unit).agg(F.sum("_gap").alias("deviation"))


def session_probability(sessions: DataFrame) -> DataFrame:
    """(location, slot, p): the mean over days; a day without a row counts as zero where its location has that day."""
    days = sessions.select("location", "day").distinct()
    return mean_over(sessions, "day", "location", "slot", members=days, value="p")


def expected_time(probability: DataFrame, unit: str, slot_minutes: int, reference: str) -> DataFrame:
    """(unit, expected_slot, expected_clock) of a probability over slots."""
    e = probability.groupBy(unit).agg(F.sum(F.col("p") * F.col("slot")).alias("expected_slot"))
    return e.withColumn("expected_clock", slot_to_clock(F.col("expected_slot"), slot_minutes, reference))


def comparative_advantage(matrix: DataFrame, row: str, column: str, value: str = "value", within: tuple[str, ...] = ()) -> DataFrame:
    """Add rca: a cell's share of its column over its row's share of everything. ``matrix`` has a row per cell.

    Totals are grouped sums that are joined back, so that the matrix never meets in one task. It is stored first, as cells and totals
    are all made from it."""
    out = matrix = cut_lineage(matrix)
    for name, by in (("_column", [*within, column]), ("_row", [*within, row])):
        out = join_on(out, matrix.groupBy(*by).agg(F.sum(value).alias(name)), by)
    whole = matrix.groupBy(*within).agg(F.sum(value).alias("_all"))
    out = join_on(out, whole, [*within]) if within else out.withColumn("_all", whole.scalar())
    share = F.try_divide(F.col("_row"), F.col("_all"))
    return out.withColumn("rca", F.try_divide(F.try_divide(F.col(value), F.col("_column")), share)).drop("_column", "_row", "_all")


def margins(table: DataFrame, row: str, column: str, value: str = "value") -> DataFrame:
    """Cells, row, column and grand totals in one pass; a null label means all."""
    sets = table.groupingSets([[row, column], [row], [column], []], row, column)
    return sets.agg(F.grouping_id().alias("level"), F.sum(value).alias("total"))


def service_space(advantage: DataFrame, row: str, column: str) -> DataFrame:
    """(a, b, proximity): rows in which both have an advantage above 1, over the larger number of either; for all pairs of
    labels that occur. The diagonal is 1, 0/0 is null. Rows with an advantage are found before the self-join."""
    labels = advantage.select(F.col(column).alias("a")).distinct()
    has = advantage.where("rca > 1").select(row, column).distinct()
    both = (
        has.select(row, F.col(column).alias("a"))
        .join(has.select(row, F.col(column).alias("b")), row)
        .groupBy("a", "b")
        .agg(F.count("*").alias("both"))
    )
    n = has.groupBy(F.col(column).alias("a")).agg(F.count("*").alias("n"))
    known = labels.join(n, "a", "left").select("a", F.coalesce("n", F.lit(0)).alias("n"))
    grid = known.crossJoin(F.broadcast(known.select(F.col("a").alias("b"), F.col("n").alias("m"))))  # labels only
    joined = grid.join(both, ["a", "b"], "left")
    return joined.select("a", "b", F.try_divide(F.coalesce("both", F.lit(0)), F.greatest("n", "m")).alias("proximity"))


def log10_consumption(cube: DataFrame, service: str = "service") -> DataFrame:
    sums = cube.groupBy(service).agg(F.sum("value").alias("_v"))
    return sums.select(service, log10_plus_one(F.col("_v")).alias("log10_consumption"))


def dominant_category(advantage: DataFrame, label: str, category: str, order: list[str], default: str) -> DataFrame:
    """(label, category): the last category, in the given order, in which a label has an advantage; else the default."""
    pos = F.array_position(F.array(*map(F.lit, order)), F.col(category))
    best = F.max_by(F.when(F.col("rca") > 1, F.col(category)), F.when(F.col("rca") > 1, pos))
    return advantage.groupBy(label).agg(F.coalesce(best, F.lit(default)).alias("category"))


def social_share(consumption: DataFrame, unit: str, services: list[str]) -> DataFrame:
    """(unit, social_share): the part of a unit's consumption that falls to the listed services."""
    some = F.sum(F.when(F.col("service").isin(services), F.col("value")).otherwise(0.0))
    return consumption.groupBy(unit).agg(F.try_divide(some, F.sum("value")).alias("social_share"))


def consumption_in_window(cube: DataFrame, start: str, end: str, *by: str) -> DataFrame:
    """Sums over a clock window, ends included; a window whose start is after its end wraps midnight."""
    t = F.col("time")
    inside = t.between(start, end) if start <= end else (t >= start) | (t <= end)
    return cube.where(inside).groupBy(*by).agg(F.sum("value").alias("value"))
