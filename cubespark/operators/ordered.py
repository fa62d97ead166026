"""Running totals and joins by key that hold at any group size: a group's rows are split by range, never gathered in one task; and how many
tasks a step takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.sources.store import cut_lineage


#: Rows of narrow tables that are worth a task where each of them takes much work or makes many others.
ROWS_A_TASK = 20_000


def tasks_for(*tables: DataFrame) -> int:
    """The tasks for a step over ``tables``: spark.sql.shuffle.partitions, or more, so that none has over ROWS_A_TASK of their rows.

    Narrow tables are few bytes, so Spark reads them in one task, merges their partitions and broadcasts them, whatever is made of
    their rows then. The rows are counted: of Parquet files and what is computed from each row, that reads the footers only."""
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(t.count() for t in tables) // ROWS_A_TASK))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys in which a null equals a null; every row of one side, if there are no keys. ``right`` then has one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def running_total(rows: DataFrame, by: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over a group's rows up to and with each row, in the order of ``order``."""
    return running_totals(rows, by, order, {name: amount})


def running_totals(rows: DataFrame, by: list[str], order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Add, under each name, the sum of an amount over a group's rows up to and with each row, in the order of ``order``.

    Rows are put into ranges of (by, order) and stored; each range sums up by itself, from the total of the ranges before it, which is
    a table with a row per group and range."""
    parts = rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    parts = cut_lineage(parts)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy(*by, "_part").agg(*[F.sum(amount).alias(f"_own_{name}") for name, amount in amounts.items()])
    each = each.select(*by, "_part", *[F.coalesce(F.sum(f"_own_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in amounts])
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.select("*", *[F.sum(amount).over(own).alias(f"_upto_{name}") for name, amount in amounts.items()])
    total = join_on(summed, each, [*by, "_part"])
    return total.select(*rows.columns, *[(F.col(f"_before_{name}") + F.col(f"_upto_{name}")).alias(name) for name in amounts])
