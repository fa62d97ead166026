"""The four pipelines: one session, minutes drawn once and stored, tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.operators import cube as C
from cubespark.operators import indices as X
from cubespark.operators import sampling as M
from cubespark.operators.income import amenity_samples, cube_by_class, income_classes
from cubespark.operators.spatial import regrid as regrid_cube
from cubespark.sources.store import cut_lineage, shared_path


def _minutes(cube: DataFrame, rates: DataFrame, n: int, technique: str = "individual") -> DataFrame:
    return cut_lineage(M.screen_time_samples(cube, rates, n, technique))


def stored(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a pipeline written below the shared folder, each under its name, and read back."""
    paths = {name: shared_path(df.sparkSession, name) for name, df in tables.items()}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    return {name: df.sparkSession.read.schema(df.schema).parquet(paths[name]) for name, df in tables.items()}


def nsi(
    cube: DataFrame, rates: DataFrame, incomes: DataFrame, qs: list[float], n_samples: int, tiles: DataFrame, open_at_night: DataFrame, size: float
) -> dict[str, DataFrame]:
    """The night index of one sample with incomes, its class means with deviations over all samples, and the class means of the
    one sample without the tiles of many places ``open_at_night``, by threshold and buffer."""
    minutes, incomes = _minutes(cube, rates, n_samples), cut_lineage(incomes)  # read in each pass of the quantiles
    index = cut_lineage(X.night_index(minutes, "tile", ("sample", "city")))
    classes = income_classes(incomes, qs).where("income_class is not null").drop("log2_income")
    per = index.join(classes, "tile").groupBy("sample", "income_class").agg(F.avg("night_index").alias("a"))
    quiet = amenity_samples(minutes.where("sample = 0").drop("sample"), tiles, open_at_night, size, None)
    quiet = cut_lineage(X.night_index(quiet, "tile", ("threshold", "buffer_m", "city")))
    left = income_classes(incomes.join(quiet.select("tile").distinct(), "tile", "left_semi"), qs).where("income_class is not null").drop("log2_income")
    return {
        "nsi_income": index.where("sample = 0").drop("sample").join(incomes, "tile"),
        "nsi_income_robust": per.groupBy("income_class").agg(F.avg("a").alias("mean"), F.stddev_samp("a").alias("std")),
        "nsi_income_robust_amenity": quiet.join(left, "tile").groupBy("threshold", "buffer_m", "income_class").agg(F.avg("night_index").alias("night_index")),
    }


def _rca(rows: DataFrame, incomes: DataFrame, qs: list[float], *scope: str) -> DataFrame:
    tiles = cut_lineage(rows.select(*scope, "tile").distinct().join(incomes, "tile"))  # read in each pass of the quantiles
    sums = C.sum_over(cube_by_class(rows, income_classes(tiles, qs, scope), scope), *scope, "income_class", "service")
    return X.comparative_advantage(sums, "income_class", "service", within=scope)


def rca(
    cube: DataFrame, rates: DataFrame, incomes: DataFrame, qs: list[float], n_samples: int, tiles: DataFrame, open_at_night: DataFrame, size: float
) -> dict[str, DataFrame]:
    """The advantage of income classes by service: of one sample, of all samples by either technique, and of the one sample
    without the tiles of many places ``open_at_night``, by threshold and buffer."""
    minutes = {t: _minutes(cube, rates, n_samples, t) for t in M.TECHNIQUES}
    many = {t: _rca(v, incomes, qs, "sample") for t, v in minutes.items()}
    quiet = amenity_samples(minutes["individual"].where("sample = 0").drop("sample"), tiles, open_at_night, size, None)
    return {
        "rca": many["individual"].where("sample = 0").drop("sample"),
        **{f"rca_samples_{t}": v for t, v in many.items()},
        "rca_samples_amenity": _rca(quiet, incomes, qs, "threshold", "buffer_m"),
    }


def other(cube: DataFrame, rates: DataFrame, incomes: DataFrame, qs: list[float], geometry: DataFrame) -> dict[str, DataFrame]:
    """The night index of tiles with class and geometry, and of services; the advantage of classes by time."""
    minutes = _minutes(cube, rates, 1).drop("sample")
    classes = income_classes(incomes, qs).where("income_class is not null")
    by_time = C.sum_over(cube_by_class(minutes, classes.drop("log2_income")), "income_class", "slot")
    return {
        "nsi_income_geo": X.night_index(minutes, "tile").join(classes, "tile").join(geometry.withColumnRenamed("key", "tile"), "tile"),
        "nsi_service": X.night_index(minutes, "service"),
        "rca_income_time": X.comparative_advantage(by_time, "income_class", "slot"),
    }


def regrid(cells: DataFrame, overlaps: DataFrame, unit_area: float) -> str:
    """Re-grid a cell cube and write it by service; the path."""
    path = shared_path(cells.sparkSession, "regrid")
    regrid_cube(cells, overlaps, unit_area, ["value"], "weighted_sum", "service", "slot").write.partitionBy("service").parquet(path)
    return path
