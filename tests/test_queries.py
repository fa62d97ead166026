"""Every registered query of the cube engine against its SQL on the smallest tables, and the plans of the central ones."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cubespark.plans import pipelines
from cubespark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(row: tuple) -> tuple:
    return tuple(round(x, 4) + 0.0 if isinstance(x, float) else x for x in row)


#: What has far fewer values than there are units. A window by these alone would put all of a city's or a slot's units into one task.
FEW = {"city", "slot", "time", "sample", "threshold", "buffer_m", "service", "income_class"}


def hot_steps(df) -> list[str]:
    """Of a plan: windows whose keys lack the unit, and exchanges into one task, over rows that no aggregation has reduced; products."""
    found: list[str] = []

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        text = node.simpleString(1000)
        below = children(node)
        if name == "WindowExec" and {k.split("#")[0] for k in keys(node.partitionSpec())} <= FEW and not reduced(node):
            found.append(text)
        if name == "ShuffleExchangeExec" and "SinglePartition, ENSURE" in text and not reduced(node):
            found.append(text)
        if "CartesianProduct" in name:
            found.append(text)
        for child in below:
            walk(child)

    def keys(spec) -> list[str]:
        return [str(spec.apply(i)) for i in range(spec.size())]

    def children(node) -> list:
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return [node.inputPlan()]
        c = node.children()
        return [c.apply(i) for i in range(c.size())]

    def reduced(node) -> bool:
        """Whether all rows that reach a node have been grouped, or are a literal table."""
        below = children(node)
        name = node.getClass().getSimpleName()
        if "Aggregate" in name or name in ("LocalTableScanExec", "RDDScanExec", "RangeExec") or "Limit" in name:
            return True
        return bool(below) and all(map(reduced, below))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_hot_steps_are_seen(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("event_type", "service")
    assert hot_steps(events.withColumn("m", F.avg("value").over(Window.partitionBy("service"))))
    assert hot_steps(events.withColumn("m", F.avg("value").over(Window.partitionBy())))
    assert hot_steps(events.repartition(1)) == []  # asked for by number, not needed by a step
    assert not hot_steps(events.withColumn("m", F.avg("value").over(Window.partitionBy("service", "user_id"))))
    sums = events.groupBy("service").agg(F.sum("value").alias("v"))
    assert not hot_steps(sums.withColumn("r", F.row_number().over(Window.partitionBy().orderBy("v"))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert not hot_steps(df)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(canonical(tuple(r[columns.index(c)] for c in sorted(columns))) for r in cur.fetchall())
    assert Counter(canonical(tuple(r[c] for c in sorted(columns))) for r in got) == want


@pytest.mark.parametrize("name", ["nsi_tile", "spatial_overlap", "amenity_counts", "regrid_cube", "screen_time_individual", "rca", "service_space"])
def test_plans_have_no_unbounded_products(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name == "service_space"  # there, labels by labels


def test_stored_tables_are_joined_in_place(spark):
    plan = QUERIES["regrid_cube_stored"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan[plan.index("SortMergeJoin") :]


@pytest.mark.parametrize(
    ("name", "tables"),
    [
        ("pipeline_nsi", {"nsi_income", "nsi_income_robust", "nsi_income_robust_amenity"}),
        ("pipeline_rca", {"rca", "rca_samples_individual", "rca_samples_mean", "rca_samples_amenity"}),
        ("pipeline_other", {"nsi_income_geo", "nsi_service", "rca_income_time"}),
    ],
)
def test_pipelines_write_all_their_tables(spark, tmp_path, monkeypatch, name, tables):
    monkeypatch.setattr(pipelines, "shared_path", lambda _, table: f"{tmp_path}/{table}")
    QUERIES[name](spark, SF)
    assert {p.name for p in tmp_path.iterdir()} == tables
    assert all(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir())
