"""Income classes, amenities and noise, and their relation to the night index.

The scope of income classes is explicit: pooled over all tiles passed in, per city, or per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.functions.scalars import interval_class, log2, log2_plus_one
from cubespark.operators.cube import mean_over, quantiles
from cubespark.operators.spatial import perform_aggregation, points_in_buffer, points_near_polygons, polygon_overlaps
from cubespark.sources.store import cut_lineage

# Amenity codes of daily life, and of places that are open at night.
FREQUENT = (
    "A203", "A206", "A207", "A208", "A501", "A504", "B101", "B102", "B201", "B203", "B204", "B301", "B316", "C101", "C104",
    "C201", "D201", "D307", "E101", "E107", "E108", "F101", "F103", "F107", "F121", "F303", "F312",
)
OPEN_AT_NIGHT = (
    "A101", "A104", "A504", "B101", "B316", "D106", "D303", "D307", "E102", "E107", "E108", "F101", "F103", "F107", "F121",
    "F303", "G102", "G103",
)
CLASSES = {"frequent": FREQUENT, "open_at_night": OPEN_AT_NIGHT}


def of_class(name: str) -> Column:
    """Whether an amenity's code is in a class."""
    return F.col("code").isin(*CLASSES[name])


def log2_income(admin: DataFrame, income: str = "Ind_snv", persons: str = "Ind") -> DataFrame:
    """(tile, log2_income) of the mean income; null where it is not positive."""
    return admin.select("tile", log2(F.try_divide(income, persons)).alias("log2_income"))


def income_classes(incomes: DataFrame, qs: list[float], scope: tuple[str, ...] = (), labels: list[str] | None = None) -> DataFrame:
    """Add income_class by quantiles of log2_income over the rows of each scope; right-closed, null without an income."""
    labels = labels or [f"q{k}" for k in range(len(qs) + 1)]
    cut = quantiles(incomes, "log2_income", qs, scope)
    # Without a scope the cut is one row; with one it has a row per city or sample.
    joined = incomes.join(cut, list(scope)) if scope else incomes.crossJoin(F.broadcast(cut))
    edges = [F.col(f"q{i}") for i in range(len(qs))]
    return joined.withColumn("income_class", interval_class(F.col("log2_income"), edges, labels)).drop(*[f"q{i}" for i in range(len(qs))])


def cube_by_class(cube: DataFrame, classes: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the tiles of a class: (scope, income_class, service, slot, value). ``classes``: (tile, scope, income_class)."""
    known = classes.where("income_class is not null").select("tile", *scope, "income_class")
    joined = cube.join(known, ["tile", *scope])
    return mean_over(joined, "tile", *scope, "income_class", "service", "slot", members=known)


def amenity_counts(tiles: DataFrame, amenities: DataFrame, radius: float, size: float, name: str = "log2_count", codes: Column | None = None) -> DataFrame:
    """(tile, name): log2(1 + n) of the amenities within ``radius`` of each tile; ``codes`` is a condition on code."""
    some = amenities if codes is None else amenities.where(codes)
    counts = points_in_buffer(tiles, some, radius, size).groupBy("key").agg(F.count("*").alias("_n"))
    return tiles.select("key").join(counts, "key", "left").select(
        F.col("key").alias("tile"), log2_plus_one(F.coalesce("_n", F.lit(0))).alias(name)
    )


def amenity_counts_near(shapes: DataFrame, amenities: DataFrame, radius: float, size: float, **classes: Column | None) -> DataFrame:
    """(tile, a column for each class): log2(1 + n) of the amenities in or within ``radius`` of polygons (key, geometry). A class is a
    condition on code, or None for all."""
    points = amenities.withColumn("id", F.monotonically_increasing_id())
    conditions = [F.count_if(F.lit(True) if c is None else c).alias(name) for name, c in classes.items()]
    counts = points_near_polygons(shapes, cut_lineage(points), radius, size).groupBy("key").agg(*conditions)
    each = [log2_plus_one(F.coalesce(name, F.lit(0))).alias(name) for name in classes]
    return shapes.select("key").join(counts, "key", "left").select(F.col("key").alias("tile"), *each)


def zonal_mean(zones: DataFrame, units: DataFrame, value: str, size: float) -> DataFrame:
    """(key, value): the mean of the zones (key, geometry, value) that units (key, geometry) overlap, weighted by area."""
    pairs = polygon_overlaps(zones, units, size)
    joined = pairs.join(zones.select(F.col("key").alias("src"), value).hint("merge"), "src")
    return perform_aggregation(joined, [value], "weighted_mean", "dst").withColumnRenamed("dst", "key")


def without_busy_nights(cube: DataFrame, counts: DataFrame, threshold: float, name: str = "log2_count") -> DataFrame:
    """The cube without tiles whose count is above the threshold; tiles without a count stay."""
    return cube.join(counts.where(F.col(name) > threshold).select("tile"), "tile", "left_anti")


# Thresholds and buffers in metres of the robustness runs.
THRESHOLDS_AND_BUFFERS = ((0, 500), (0, 200), (3, 1000), (3, 500), (3, 200), (6, 1000), (6, 500))


def amenity_samples(cube: DataFrame, tiles: DataFrame, amenities: DataFrame, size: float, codes: Column | None, pairs=THRESHOLDS_AND_BUFFERS) -> DataFrame:
    """The cube once for each (threshold, buffer_m), as columns, without busy tiles. Counts are made once per buffer."""
    counts = None
    for buffer in sorted({b for _, b in pairs}):
        one = amenity_counts(tiles, amenities, buffer, size, codes=codes).withColumn("buffer_m", F.lit(buffer))
        counts = one if counts is None else counts.unionByName(one)
    every = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(b).alias("buffer_m")) for t, b in pairs])
    wide = cube.withColumn("_p", F.explode(every)).select(*cube.columns, "_p.threshold", "_p.buffer_m")
    busy = counts.withColumnRenamed("log2_count", "_c")
    kept = wide.join(busy, ["tile", "buffer_m"], "left").where("_c is null or _c <= threshold")
    return kept.drop("_c")
