"""Sums over a stream of event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.sources.store import shared_path


def rollup(events: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Sums and counts by columns; the same on a batch or a stream."""
    return events.groupBy(*by).agg(F.sum(value).alias(value), F.count("*").alias("n"))


def rolled_up(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Read all that is at ``path`` as a stream, batch by batch, keep the latest sums, and return them.

    Each batch writes the whole result under its own number, so a batch that runs twice does no harm."""
    schema = spark.read.parquet(path).schema
    anywhere = f"{path[:-1]}[{path[-1]}]"  # as a pattern: a stream's plain path has to be a folder, and a table may be one file
    stream = spark.readStream.schema(schema).parquet(anywhere)
    out = shared_path(spark, "rollup")
    state = rollup(stream, by)
    last = None

    def keep(batch: DataFrame, number: int) -> None:
        nonlocal last
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last = number

    q = state.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-state-{uuid.uuid4().hex}")
    running = q.trigger(availableNow=True).start()
    running.awaitTermination()
    if last is None:  # there was nothing to read, so no batch
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(f"{out}/{last}")
