"""GeoJSON features with polygons, holes and several parts.

A geometry is an array of polygons, each an array of rings, the outer one first (see cubespark.operators.geometry). One polygon is
written as a Polygon, others as a MultiPolygon, always with closed rings. Geometries of other types are read as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POLYGON = "array<array<array<double>>>"


def _numbers(ring: Column) -> Column:
    """The pairs of numbers of a ring, closed."""
    first, last = F.get(ring, 0), F.get(ring, F.size(ring) - 1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.array(first)))
    return F.transform(closed, lambda p: F.array(p["x"], p["y"]))


def write_features(df: DataFrame, path: str, geometry: str = "geometry", properties: list[str] | None = None) -> None:
    """One feature a line; the other columns, or those named, are its properties. A null geometry stays null."""
    names = properties if properties is not None else [c for c in df.columns if c != geometry]
    polygons = F.transform(geometry, lambda polygon: F.transform(polygon, _numbers))

    def feature(kind: str, coordinates: Column) -> Column:
        shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*names).alias("properties"), shape.alias("geometry")))

    none = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*names).alias("properties"), F.lit(None).cast("string").alias("geometry")))
    line = F.when(F.size(geometry) == 1, feature("Polygon", F.get(polygons, 0))).when(F.col(geometry).isNotNull(), feature("MultiPolygon", polygons))
    df.select(F.coalesce(line, none).alias("value")).write.text(path)


def read_features(spark: SparkSession, path: str, properties: str, collection: bool = False) -> DataFrame:
    """The properties of features, their ``kind`` and ``geometry``; ``collection`` for one document with a list of features. Coordinates
    are read as text first, since how deep they nest depends on the type."""
    feature = f"type string, properties struct<{properties}>, geometry struct<type: string, coordinates: string>"
    if collection:
        nested = feature.replace("type string", "type: string").replace("properties struct", "properties: struct").replace("geometry struct", "geometry: struct")
        rows = spark.read.schema(f"features array<struct<{nested}>>").json(path, multiLine=True)
        rows = rows.select(F.explode("features").alias("f")).select("f.*")
    else:
        rows = spark.read.schema(feature).json(path)
    text, kind = F.col("geometry.coordinates"), F.col("geometry.type")
    one, more = F.array(F.from_json(text, _POLYGON)), F.from_json(text, f"array<{_POLYGON}>")
    coordinates = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", more)
    points = F.transform(coordinates, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return rows.select("properties.*", kind.alias("kind"), points.alias("geometry"))
