"""The four pipelines, with every table that they write, and the stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions.scalars import rounded
from cubespark.plans import pipelines
from cubespark.queries.base import (
    AMENITY, CELL_CUBE, CLASS, CUBE, OVERLAP, QS, TILES, amenities, cell_cube, stored_cube, incomes, open_at_night, query, tile_boxes,
)
from cubespark.queries.sampling import MEAN_MINUTES, MINUTES, N_SAMPLES, nsi_over, rates, rca_samples_sql
from cubespark.queries.spatial import BUCKET, SAMPLES, overlaps
from cubespark.streaming.rollup import rolled_up

R = rounded


def told(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table_name, key, measure, value): all tables of a pipeline, a row per key and other column."""
    out = None
    for name, by in keys.items():
        df = tables[name]
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), R(F.col(c).cast("double")).alias("value")) for c in df.columns if c not in by]))
        rows = df.select(F.lit(name).alias("table_name"), F.concat_ws(":", *[F.col(c).cast("string") for c in by]).alias("key"), each.alias("e")).select("table_name", "key", "e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _renamed(sql: str, prefix: str) -> str:
    """A chain of common table expressions under other names."""
    for name in set(re.findall(r"(\w+) as \(", sql)):
        sql = re.sub(rf"\b{name}\b", f"{prefix}_{name}", sql)
    return sql


def _rows(name: str, key: str, measures: dict[str, str], source: str) -> str:
    values = ", ".join(f"round({v}, 6) + 0 as m{i}" for i, v in enumerate(measures.values()))
    return f"""select '{name}' table_name, k as "key", unnest([{', '.join(f"'{m}'" for m in measures)}]) measure, unnest([{', '.join(f'm{i}' for i in range(len(measures)))}]) as value
from (select concat_ws(':', {key}) k, {values} from {source})"""


_ONE = "one as materialized (select * exclude (sample) from st where sample = 0)"
_QUIET = SAMPLES.replace("cube.*", "one.*").replace("join cube ", "join one ")


@query(
    f"""with {CUBE}, {TILES}, {AMENITY}, {MINUTES}, {nsi_over('st', 'sample')}, {CLASS}, {_ONE}, {_QUIET},
{_renamed(nsi_over('samples', 'threshold, buffer_m'), 'q')},
lf as (select tile, li from inc where tile in (select tile from q_nsi)), lc as (select quantile_cont(li, 0.3) a, quantile_cont(li, 0.7) b from lf),
ls as (select tile, case when li <= a then 'q0' when li <= b then 'q1' else 'q2' end c from lf, lc where li is not null),
per as (select sample, c, avg(nsi) a from nsi join cls using (tile) group by 1, 2), rb as (select c, avg(a) mean, stddev_samp(a) std from per group by 1),
ra as (select threshold, buffer_m, c, avg(q_nsi) a from q_nsi join ls using (tile) group by 1, 2, 3)
{_rows('nsi_income', 'city, tile', {'night_index': 'nsi', 'log2_income': 'li'}, 'nsi join inc using (tile) where sample = 0')}
union all {_rows('nsi_income_robust', 'c', {'mean': 'mean', 'std': 'std'}, 'rb')}
union all {_rows('nsi_income_robust_amenity', 'threshold, buffer_m, c', {'night_index': 'a'}, 'ra')}"""
)
def pipeline_nsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    night = amenities(spark, sf_dir).where(open_at_night())
    tables = pipelines.nsi(c, rates(spark), incomes(spark, sf_dir, c), QS, N_SAMPLES, tile_boxes(spark, sf_dir), night, BUCKET)
    keys = {"nsi_income": ["city", "tile"], "nsi_income_robust": ["income_class"], "nsi_income_robust_amenity": ["threshold", "buffer_m", "income_class"]}
    return told(pipelines.stored(tables), keys)


@query(
    f"""with {CUBE}, {TILES}, {AMENITY}, {MINUTES}, {rca_samples_sql('st', 'sample')}, {MEAN_MINUTES}, {_renamed(rca_samples_sql('mst', 'sample'), 'w')},
{_ONE}, {_QUIET}, {_renamed(rca_samples_sql('samples', 'threshold, buffer_m'), 'q')}
{_rows('rca', 'income_class, service', {'rca': 'rca'}, 'rca where sample = 0')}
union all {_rows('rca_samples_individual', 'sample, income_class, service', {'rca': 'rca'}, 'rca')}
union all {_rows('rca_samples_mean', 'sample, income_class, service', {'rca': 'w_rca'}, 'w_rca')}
union all {_rows('rca_samples_amenity', 'threshold, buffer_m, income_class, service', {'rca': 'q_rca'}, 'q_rca')}"""
)
def pipeline_rca(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    night = amenities(spark, sf_dir).where(open_at_night())
    tables = pipelines.rca(c, rates(spark), incomes(spark, sf_dir, c), QS, N_SAMPLES, tile_boxes(spark, sf_dir), night, BUCKET)
    tables = {name: df.drop("value") for name, df in pipelines.stored(tables).items()}
    cell = ["income_class", "service"]
    keys = {"rca": cell, "rca_samples_individual": ["sample", *cell], "rca_samples_mean": ["sample", *cell], "rca_samples_amenity": ["threshold", "buffer_m", *cell]}
    return told(tables, keys)


@query(
    f"""with {CUBE}, {TILES}, {MINUTES}, one as materialized (select * from st where sample = 0), {nsi_over('one', 'sample')}, {_renamed(nsi_over('one', 'sample').replace('tile', 'service'), 's')}, {CLASS},
cn as (select c, count(*) n from cls group by 1), bt as (select c, slot, sum(v) / any_value(n) v from one join cls using (tile) join cn using (c) group by 1, 2),
tc as (select c, slot, v / nullif(sum(v) over (partition by slot), 0) / nullif(sum(v) over (partition by c) / nullif(sum(v) over (), 0), 0) a from bt)
{_rows('nsi_income_geo', 'city, tile, c', {'night_index': 'nsi', 'log2_income': 'li', 'xmin': 'x0', 'ymin': 'y0', 'xmax': 'x0 + 200', 'ymax': 'y0 + 200'}, 'nsi join cls using (tile) join inc using (tile) join tile_geo on tile_geo.key = nsi.tile')}
union all {_rows('nsi_service', 'city, service', {'night_index': 's_nsi'}, 's_nsi')}
union all {_rows('rca_income_time', 'c, slot', {'rca': 'a'}, 'tc')}"""
)
def pipeline_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    tables = pipelines.stored(pipelines.other(c, rates(spark), incomes(spark, sf_dir, c), QS, tile_boxes(spark, sf_dir)))
    tables["rca_income_time"] = tables["rca_income_time"].drop("value")
    keys = {"nsi_income_geo": ["city", "tile", "income_class"], "nsi_service": ["city", "service"], "rca_income_time": ["income_class", "slot"]}
    return told(tables, keys)


@query(
    f"""with {OVERLAP}, {CELL_CUBE}, good as (select dst from ov group by 1 having sum(area) / 40000 > 0.8)
select dst, service, round(sum(v * area / 10000), 6) + 0 as value from cell_cube join ov using (src) join good using (dst) group by 1, 2"""
)
def pipeline_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pipelines.regrid(cell_cube(spark, sf_dir), overlaps(spark, sf_dir), 40_000.0)
    back = spark.read.parquet(path)
    return back.groupBy("dst", "service").agg(R(F.sum("value")).alias("value"))


@query("select event_type, round(sum(value), 6) as value, count(*) n from events group by 1")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's sums from a stream over the events' files, as it stands when the input is read."""
    got = rolled_up(spark, f"{sf_dir}/events.parquet", ["event_type"])
    return got.select("event_type", R(F.col("value")).alias("value"), "n")
