"""What a step's tasks hold grows no faster than the input: tasks by rows, nothing broadcast, one file for a bucket."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from cubespark.operators import ordered, sampling
from cubespark.operators import spatial as P
from cubespark.queries import QUERIES
from cubespark.sources import store

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bucket_is_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_path", lambda _, name: f"file://{tmp_path}/{name}")
    got = store.write_bucketed(spark.range(1000).repartition(4), "ids", "id", 8)
    assert len([f for f in os.listdir(f"{tmp_path}/ids") if f.endswith(".parquet")]) == 8
    assert got.count() == 1000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["spatial_overlap", "spatial_overlap_polygon", "spatial_overlap_rings", "amenity_counts_polygon", "zonal_noise_polygon"])
def test_shapes_are_not_broadcast(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not re.search(r"BroadcastHashJoin \[level", plan)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    boxes = spark.range(100).select(F.col("id").alias("key"), *[(F.col("id") * 3.0 + d).alias(c) for c, d in zip(P.BOX, (0, 0, 2, 2), strict=True)])
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 10)
    got = P.box_overlaps(boxes, boxes, 2.0)
    assert re.search(r"hashpartitioning\(level#\d+, cx#\d+L, cy#\d+L, 20\)", plan_of(got))
    assert got.where("src = dst and area = 4").count() == got.count() == 100


def test_values_are_counted_once_for_all_samples(spark, monkeypatch):
    values: list[int] = []
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: values.append(df.where("_kind = 0").count()) or store.cut_lineage(df))
    cube = spark.range(10).selectExpr("'a' city", "id tile", "'s' service", "1 slot", "if(id = 9, null, id / 2.0D) value")
    rates = spark.createDataFrame([("s", 60.0)], "service string, mb_per_hour double")
    got = sampling.screen_time_individual(cube, rates, 5).collect()
    assert values == [9]
    marks = sampling.ticks(sampling.with_samples(spark.createDataFrame([("a", "s", 60.0, 4.0)], "city string, service string, mb_per_hour double, most double"), 5), "0").collect()
    for r in got:
        below = None if r.tile == 9 else sum(m["sample"] == r["sample"] and m.cum < r.tile / 2 for m in marks)
        assert r.value == below
    assert len(got) == 50


def test_ties_are_not_below(spark):
    values = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", None), (None, 2.0)], "k string, x double")
    marks = spark.createDataFrame([("g", 0, 1.0), ("g", 1, 0.5), ("g", 1, 1.5), (None, 0, 1.0)], "k string, sample int, m double")
    got = {(r.k, r.x): r.below for r in sampling.counts_below(values, marks, ["k"], "x", "m", 2).collect()}
    assert got == {("g", 1.0): [0, 1], ("g", 2.0): [1, 2], ("g", None): None, (None, 2.0): [1, 0]}
