"""Spatial joins without a geometry library: a hierarchical grid, an equi-join on its cells, and the exact predicate.

Cells of level l have the side ``size`` * 2 ** l. A shape stands at the level whose cells are at least as wide and as high as it is, so it
touches four of them at most, however large it is. Shapes of different levels meet in the larger one's cells: the smaller one also
takes the cells that it touches at the levels that the other side has, again four of each. A pair of boxes is kept once, in the cell
of the lower left corner of its overlap. No pair of distant shapes is made. Nothing is broadcast: tables of shapes are few bytes for many
rows, so both sides are dealt by cell over a number of tasks that grows with the rows, and merged.

A polygon that is to be overlapped is first cut into disjoint parts, each in one cell: cells that it covers are taken whole and only
cells that its boundary crosses are clipped. So a small shape meets the few edges near it instead of a large polygon's all, and parts
of one large polygon are rows of different cells instead of one hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.operators import geometry as G
from cubespark.operators.ordered import join_on, tasks_for
from cubespark.sources.store import cut_lineage

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Parts of one polygon, besides the cells that it stands in.
PARTS = 64


def _cell(x: Column | str, side: Column | float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x / side)


def _side(level: Column | str, size: float) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(2.0), level)


def with_level(boxes: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Add the level at which a box, widened by ``margin``, stands; nulls drop out."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) + 2 * margin
    level = F.ceil(F.log2(F.greatest(extent / size, F.lit(1.0)))).cast("int")
    return boxes.withColumn("level", level).where(extent.isNotNull())


def levels_of(leveled: DataFrame) -> Column:
    """The levels that occur, as one array: a grid has some 60 at most."""
    return leveled.agg(F.collect_set("level").alias("levels")).scalar()


def _above(leveled: DataFrame, others: DataFrame) -> DataFrame:
    """The boxes that stand above the lowest level of others: only those can meet one from above."""
    return leveled.where(F.col("level") > F.array_min(levels_of(others)))


def with_cells(leveled: DataFrame, size: float, levels: Column | None = None, above: bool = False, margin: float = 0.0) -> DataFrame:
    """A row for each cell (level, cx, cy) that a box touches at its own level; or at those of ``levels`` that are not below it, or, if
    ``above``, that are above it."""
    if levels is not None:
        own = F.col("level")
        some = F.filter("_levels", lambda l: (l > own) if above else (l >= own))
        leveled = leveled.withColumn("_levels", levels).withColumn("level", F.explode(some)).drop("_levels")
    side = _side("level", size)
    low, high = [F.col(c) - margin for c in BOX[:2]], [F.col(c) + margin for c in BOX[2:]]
    across, up = (F.sequence(_cell(a, side), _cell(b, side)) for a, b in zip(low, high, strict=True))
    return leveled.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(up))


CELL = ("level", "cx", "cy")


def _dealt(s: DataFrame, p: DataFrame, n: int, names: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of cells as both sides of a join on them, in ``n`` tasks and under the names of one letter."""
    s, p = (t.repartition(n, *CELL).alias(name) for t, name in zip((s, p), names, strict=True))
    return s, p.hint("merge")


def _same_cell(a: str, b: str) -> Column:
    return (F.col(f"{a}.level") == F.col(f"{b}.level")) & (F.col(f"{a}.cx") == F.col(f"{b}.cx")) & (F.col(f"{a}.cy") == F.col(f"{b}.cy"))


def box_overlaps(src: DataFrame, dst: DataFrame, size: float) -> DataFrame:
    """(src, dst, area) of all pairs of boxes that overlap. Inputs: (key, xmin, ymin, xmax, ymax). ``size`` is the side of the
    smallest cells: about that of the smaller boxes."""
    n = tasks_for(src, dst)
    src, dst = with_level(src.select("key", *BOX), size), with_level(dst.select("key", *BOX), size)

    def pairs(s: DataFrame, d: DataFrame) -> DataFrame:
        s, d = _dealt(s, d, n, "sd")
        x0, y0 = F.greatest("s.xmin", "d.xmin"), F.greatest("s.ymin", "d.ymin")
        width, height = F.least("s.xmax", "d.xmax") - x0, F.least("s.ymax", "d.ymax") - y0
        here = _same_cell("s", "d")
        side = _side("s.level", size)
        corner = (_cell(x0, side) == F.col("s.cx")) & (_cell(y0, side) == F.col("s.cy"))
        met = s.join(d, here & (width > 0) & (height > 0) & corner)
        return met.select(F.col("s.key").alias("src"), F.col("d.key").alias("dst"), (width * height).cast("double").alias("area"))

    up = pairs(with_cells(src, size, levels_of(dst)), with_cells(dst, size))
    down = pairs(with_cells(_above(src, dst), size), with_cells(dst, size, levels_of(src), above=True))
    return up.unionByName(down)


def ring_area(ring: Column) -> Column:
    """The area of a simple ring of points (x, y), closed or not."""
    return F.abs(G.signed_ring_area(ring))


def _parts(size: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cells, parts = [], [], []
            for i, (level, rings) in enumerate(zip(batch["level"].to_pylist(), G.arrays_of(batch["rings"]), strict=True)):
                for *cell, held in G.parts_of(rings, size, level, most):
                    row.append(i)
                    cells.append(cell)
                    parts.append(held)
            level, cx, cy, whole = zip(*cells, strict=True) if cells else ([], [], [], [])
            at = pa.array(row, pa.int64())
            columns = [batch["dst"].take(at), pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(whole, pa.bool_()), G.rings_of(parts)]
            yield pa.RecordBatch.from_arrays(columns, ["dst", "level", "cx", "cy", "whole", "part"])

    return run


def _rings(shapes: DataFrame, n: int) -> DataFrame:
    """(key, rings): the signed rings of shapes (key, geometry) that have some, dealt over ``n`` tasks."""
    dealt = shapes.select("key", "geometry").repartition(n, "key")
    return dealt.select("key", G.signed_rings(F.col("geometry")).alias("rings")).where("size(rings) > 0")


def polygon_parts(shapes: DataFrame, size: float, most: int = PARTS) -> DataFrame:
    """(dst, level, cx, cy, whole, part): the polygons (key, rings) cut into disjoint parts, signed rings each in one cell; ``whole`` if
    the part is its cell. At most ``most`` parts, or the four cells that the polygon stands in."""
    bounded = with_level(shapes.select("key", "rings", *G.bounds(F.col("rings"))), size)
    kind = dict(shapes.dtypes)["key"]
    schema = f"dst {kind}, level int, cx long, cy long, whole boolean, part {G.RINGS}"
    return bounded.select(F.col("key").alias("dst"), "level", "rings").mapInArrow(_parts(size, most), schema)


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        area = G.shared_areas(G.Edges(batch["rings"]), G.Edges(batch["part"]))
        yield pa.RecordBatch.from_arrays([batch["src"], batch["dst"], pa.array(area)], ["src", "dst", "area"])


def polygon_overlaps(src: DataFrame, dst: DataFrame, size: float, most: int = PARTS) -> DataFrame:
    """(src, dst, area) of all pairs of polygons that overlap, concave ones and those with holes or several parts too. Inputs: (key,
    geometry), see cubespark.operators.geometry; a null or empty geometry overlaps nothing."""
    src, dst = (_rings(t, tasks_for(t)) for t in (src, dst))
    area = [f"src {dict(src.dtypes)['key']}", f"dst {dict(dst.dtypes)['key']}", "area double"]
    # Each is read for its levels and for both joins, so both are stored.
    boxed = cut_lineage(with_level(src.select("key", "rings", *G.bounds(F.col("rings"))), size))
    parts = cut_lineage(polygon_parts(dst, size, most))
    side, own = _side("level", size), F.col("level")
    corner = [(F.col("cx") * side).alias("xmin"), (F.col("cy") * side).alias("ymin"), ((F.col("cx") + 1) * side).alias("xmax"), ((F.col("cy") + 1) * side).alias("ymax")]
    placed = parts.select("*", *corner)
    n = tasks_for(boxed, parts)

    def pairs(s: DataFrame, d: DataFrame) -> DataFrame:
        s, d = _dealt(s, d, n, "sd")
        near = (F.col("s.xmin") < F.col("d.xmax")) & (F.col("d.xmin") < F.col("s.xmax")) & (F.col("s.ymin") < F.col("d.ymax")) & (F.col("d.ymin") < F.col("s.ymax"))
        return s.join(d, _same_cell("s", "d") & near).select(F.col("s.key").alias("src"), "d.dst", "s.rings", "d.part")

    # A part is in one cell at any level, and a shape takes a cell once, so no pair of them is made twice.
    up = pairs(with_cells(boxed, size, levels_of(parts)), placed)
    raised = placed.withColumn("_levels", levels_of(boxed)).withColumn("_to", F.explode(F.filter("_levels", lambda l: l > own)))
    shrink = F.pow(F.lit(2.0), F.col("_to") - own)
    raised = raised.withColumns({"cx": F.floor(F.col("cx") / shrink), "cy": F.floor(F.col("cy") / shrink), "level": F.col("_to")})
    every = up.unionByName(pairs(with_cells(_above(boxed, parts), size), raised)).mapInArrow(_areas, ", ".join(area))
    # Most pairs share one part: there is little to add up before the rows are dealt.
    return every.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.sum("area").alias("area")).where("area > 1e-9")


def box_geometry(boxes: DataFrame) -> DataFrame:
    """(key, geometry) of boxes."""
    return boxes.select("key", G.of_ring(G.box_ring(*map(F.col, BOX))).alias("geometry"))


def ring_overlaps(boxes: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(src, dst, area) of boxes (key, xmin..ymax) and simple rings (key, ring array<struct<x, y>>) that overlap."""
    return polygon_overlaps(box_geometry(boxes), rings.select("key", G.of_ring(F.col("ring")).alias("geometry")), size)


def points_in_buffer(boxes: DataFrame, points: DataFrame, radius: float, size: float) -> DataFrame:
    """(key, code) of points (code, x, y) within ``radius`` of boxes: the exact buffer with round corners."""
    leveled = with_level(boxes.select("key", *BOX), size, radius)
    b, p = _dealt(with_cells(leveled, size, margin=radius), _points_at(points, levels_of(leveled), size), tasks_for(boxes, points), "bp")
    dx = F.greatest(F.col("b.xmin") - F.col("p.x"), F.lit(0.0), F.col("p.x") - F.col("b.xmax"))
    dy = F.greatest(F.col("b.ymin") - F.col("p.y"), F.lit(0.0), F.col("p.y") - F.col("b.ymax"))
    here = _same_cell("b", "p")
    return b.join(p, here & (dx * dx + dy * dy <= radius * radius)).select("b.key", "p.code")


def _points_at(points: DataFrame, levels: Column, size: float) -> DataFrame:
    """A row for each level of ``levels``, with the point's cell there."""
    at = points.withColumn("_levels", levels).withColumn("level", F.explode("_levels")).drop("_levels")
    side = _side("level", size)
    return at.withColumns({"cx": _cell("x", side), "cy": _cell("y", side)})


def points_near_polygons(shapes: DataFrame, points: DataFrame, radius: float, size: float, most: int = PARTS) -> DataFrame:
    """(key, id, code) of points (id, code, x, y), whose ids are unique, in or within ``radius`` of polygons (key, geometry), once each.

    Near is what has a boundary segment within the radius; segments stand in the grid by themselves, so a long boundary isn't one row.
    Inside is what lies in a cell that the polygon covers, or has a winding number about the part in its cell."""
    n_tasks = tasks_for(shapes, points)
    rings = cut_lineage(_rings(shapes, n_tasks))  # for its segments, their levels and the parts
    here = _same_cell("s", "p")
    each = rings.select("key", F.explode("rings").alias("ring"))
    n = F.size("ring")
    ends = F.transform("ring", lambda a, i: F.struct(a.alias("a"), F.get(F.col("ring"), (i + 1) % n).alias("b")))
    ends = each.select("key", F.explode(ends).alias("e")).select("key", *[F.col(f"e.{e}.{c}").alias(f"{c}{i}") for i, e in enumerate("ab") for c in "xy"])
    low, high = [F.least(f"{c}0", f"{c}1").alias(f"{c}min") for c in "xy"], [F.greatest(f"{c}0", f"{c}1").alias(f"{c}max") for c in "xy"]
    leveled = with_level(ends.select("*", *low, *high), size, radius)
    s, p = _dealt(with_cells(leveled, size, margin=radius), _points_at(points, levels_of(leveled), size), n_tasks, "sp")
    away = G.segment_distance2(*[F.col(f"s.{c}") for c in ("x0", "y0", "x1", "y1")], F.col("p.x"), F.col("p.y"))
    near = s.join(p, here & (away <= radius * radius))
    # A point meets the segments of a shape in its own cell, level by level: most repeats go where they are made.
    near = near.select(*[f"s.{c}" for c in CELL], "s.key", "p.id", "p.code").distinct().select("key", "id", "code")
    parts = cut_lineage(polygon_parts(rings, size, most))  # for its levels and the join
    inside = F.col("s.whole") | (G.winding(F.col("s.part"), F.col("p.x"), F.col("p.y")) > 0)
    s, p = _dealt(parts, _points_at(points, levels_of(parts), size), n_tasks, "sp")
    within = s.join(p, here).where(inside)
    both = near.unionByName(within.select(F.col("s.dst").alias("key"), "p.id", "p.code"))
    return both.repartition(n_tasks, "key", "id").distinct()


# -- aggregation over overlaps -----------------------------------------------------------------------------------------


def weighted_mean(value: str, area: str = "area") -> Column:
    """Mean weighted by area; rows with a null value don't weigh."""
    return F.try_divide(F.sum(F.col(value) * F.col(area)), F.sum(F.when(F.col(value).isNotNull(), F.col(area))))


def weighted_sum(value: str, source_area: float, area: str = "area") -> Column:
    """Sum of the covered shares of source units of one size."""
    return F.sum(F.col(value) * F.col(area) / F.lit(source_area))


How = str | Callable[[Column], Column]


def perform_aggregation(data: DataFrame, variables: list[str], how: How | dict[str, How], *by: str, source_area: float = 10_000.0, area: str = "area") -> DataFrame:
    """Aggregate columns as ``how`` says, for all of them or by column: weighted_mean, weighted_sum, the name of any aggregate function, or
    a callable that makes an aggregate of a column; reducer() makes one of a Python function."""
    known = {"weighted_mean": lambda v: weighted_mean(v, area), "weighted_sum": lambda v: weighted_sum(v, source_area, area)}
    native, grouped = [], []
    for v in variables:
        f = how[v] if isinstance(how, dict) else how
        made = f(F.col(v)) if callable(f) else known[f](v) if f in known else getattr(F, f)(v)
        (grouped if getattr(f, "grouped", False) else native).append(made.alias(v))
    parts = [data.groupBy(*by).agg(*exprs) for exprs in (native, grouped) if exprs]  # Spark doesn't mix the two in one aggregation
    return parts[0] if len(parts) == 1 else join_on(*parts, list(by)).select(*by, *variables)


def reducer(f: Callable[..., float], *more: str) -> Callable[[Column], Column]:
    """An aggregate of any Python function of a group's non-null values, given as a numpy array, and of the columns ``more`` beside
    them (weights, say). A group's values meet in one task, so this is for functions that can't be put together from partial ones; a
    group without values is null."""

    def reduce(*columns: pd.Series) -> float:
        kept = columns[0].notna().to_numpy()
        return float(f(*[c.to_numpy()[kept] for c in columns])) if kept.any() else None

    udf = {0: lambda v: reduce(v), 1: lambda v, w: reduce(v, w)}[len(more)]
    udf.__annotations__ = dict.fromkeys(("v", "w")[: 1 + len(more)], pd.Series) | {"return": float}
    made = F.pandas_udf(udf, "double")

    def aggregate(column: Column) -> Column:
        return made(column, *more)

    aggregate.grouped = True
    return aggregate


def covered_share(overlaps: DataFrame, unit_area: float | DataFrame) -> DataFrame:
    """(dst, covered): the part of each destination unit that sources cover. ``unit_area``: a number, or (dst, unit_area)."""
    sums = overlaps.groupBy("dst").agg(F.sum("area").alias("_a"))
    if isinstance(unit_area, DataFrame):
        return sums.join(unit_area.hint("merge"), "dst").select("dst", F.try_divide("_a", "unit_area").alias("covered"))
    return sums.select("dst", (F.col("_a") / unit_area).alias("covered"))


def bridge(overlaps: DataFrame, unit_area: float | DataFrame, least: float = 0.8) -> DataFrame:
    """The overlaps (src, dst, area) of destination units that are covered by more than ``least``. Cubes of any time are moved over
    it, so it is worth storing once: see regrid_stored()."""
    covered = covered_share(overlaps, unit_area).where(F.col("covered") > least).select("dst")
    return overlaps.join(covered.hint("merge"), "dst").select("src", "dst", "area")


def regrid(
    table: DataFrame, overlaps: DataFrame, unit_area: float | DataFrame, variables: list[str], how: How | dict[str, How], *keep: str,
    source_area: float = 10_000.0, least: float = 0.8,
) -> DataFrame:
    """Move a table (src, ``keep``, ``variables``) to destination units that are covered by more than ``least``.

    One join with the overlaps and one aggregation, whatever the number of times or services among ``keep``.
    """
    return perform_aggregation(table.join(bridge(overlaps, unit_area, least).hint("merge"), "src"), variables, how, "dst", *keep, source_area=source_area)


def regrid_stored(table: DataFrame, bridge: DataFrame, variables: list[str], how: How | dict[str, How], *keep: str, source_area: float = 10_000.0) -> DataFrame:
    """The same from a stored bridge. If both are bucketed by src (store.write_bucketed()), nothing is shuffled below the join."""
    return perform_aggregation(table.join(bridge.hint("merge"), "src"), variables, how, "dst", *keep, source_area=source_area)
