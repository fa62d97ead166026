"""Readers and writers with declared schemas, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CUBE_SCHEMA = "city string, tile long, service string, slot int, time string, value double"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one
    process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        where = "file://" + tempfile.mkdtemp(prefix="spark-cubespark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for clear() to delete."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has made so far, once the results that read them have been written; how many."""
    n = 0
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    while _made:
        n += _delete(spark, _made.pop())
    return n


#: Whether Spark deletes a query's shuffle files once it has run; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation.
    Nothing reads the shuffle files of the write again, so they are deleted as soon as it is done."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "cut")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is a table as cut_lineage() returned it, which has the same values each time it is read."""
    return df in _paths


def discard(*tables: DataFrame) -> None:
    """Delete tables as cut_lineage() returned them, once what was made of them is stored too: no later query may read them."""
    for table in tables:
        if path := _paths.pop(table, None):
            _delete(table.sparkSession, path)
            if path in _made:
                _made.remove(path)


_tables: list[str] = []


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table below the shared folder, hashed into ``buckets`` by ``key`` and sorted by it: tables of the same key and
    number of buckets are joined on it without moving a row. A bucket is one file of one task, sorted there, so that a task has no writer
    for each bucket and the driver no list of files from each task. clear() drops the table."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = shared_path(spark, name)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def write_cube(cube: DataFrame, path: str, *partitions: str) -> None:
    """A cube as Parquet, partitioned by city unless other columns are named."""
    cube.write.partitionBy(*(partitions or ("city",))).parquet(path)


def load_cube(spark: SparkSession, path: str, cities: list[str] | None = None, schema: str = CUBE_SCHEMA) -> DataFrame:
    """A cube, or some of its cities: a filter on the partition column, so that others are not read."""
    cube = spark.read.schema(schema).parquet(path)
    return cube.where(F.col("city").isin(cities)) if cities else cube


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a declared schema: codes that are declared as strings keep their leading zeros."""
    return spark.read.schema(schema).option("header", True).csv(path)


def attributes(table: DataFrame, keys: DataFrame, key: str, variables: list[str], base: str | None = None) -> DataFrame:
    """``variables`` of the units in ``keys``; as shares of the column ``base`` if one is named."""
    values = [F.try_divide(v, base).alias(v) if base else F.col(v) for v in variables]
    return table.join(keys.select(key).distinct(), key).select(key, *values)


def log_durations(lines: DataFrame, column: str = "line") -> DataFrame:
    """Seconds of each 'done/total [mm:ss<' mark in the lines of a progress log."""
    found = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"\[(\d+:\d\d)<"), F.lit(1))).alias("t"))
    part = F.split("t", ":")
    return found.select((part[0].cast("int") * 60 + part[1].cast("int")).alias("seconds"))
