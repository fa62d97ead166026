"""Polygons: shared areas, parts, buffers, holes and several parts, against plain computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubespark.operators import geometry as G
from cubespark.operators import spatial as P
from cubespark.sources import geojson

BOX = "key long, xmin double, ymin double, xmax double, ymax double"


def star(rng: random.Random, x: float, y: float, r: float, n: int) -> list[tuple[float, float]]:
    """A star-shaped ring about (x, y), as a rule concave."""
    turn = sorted(2 * math.pi * (k + 0.8 * rng.random()) / n for k in range(n))
    return [(x + (d := r * rng.uniform(0.3, 1)) * math.cos(t), y + d * math.sin(t)) for t in turn]


def convex_area(a: list, b: list) -> float:
    """What two convex counter-clockwise rings share, by cutting one at the other's edges."""
    for p, q in zip(b, b[1:] + b[:1], strict=True):
        out = []
        side = [(q[0] - p[0]) * (c[1] - p[1]) - (q[1] - p[1]) * (c[0] - p[0]) for c in a]
        for i, c in enumerate(a):
            d, s, t = a[(i + 1) % len(a)], side[i], side[(i + 1) % len(a)]
            if s >= 0:
                out.append(c)
            if s * t < 0:
                out.append((c[0] + s / (s - t) * (d[0] - c[0]), c[1] + s / (s - t) * (d[1] - c[1])))
        a = out
        if len(a) < 3:
            return 0.0
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, a[1:] + a[:1], strict=True)) / 2


def star_area(a: tuple, b: tuple) -> float:
    """What two stars (centre, ring) share: their triangles about the centres, each with each."""
    fans = [[[c, *e] for e in zip(r, r[1:] + r[:1], strict=True)] for c, r in (a, b)]
    return sum(convex_area(s, t) for s in fans[0] for t in fans[1])


def edges(shapes: list) -> G.Edges:
    return G.Edges(pa.array([[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in s] for s in shapes], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 12), st.integers(4, 12), st.integers(-30, 30), st.integers(-30, 30))
def test_area_shared_by_concave_rings(seed, n, m, dx, dy):
    rng = random.Random(seed)
    dx, dy = dx / 10, dy / 10
    a, b = star(rng, 0, 0, 2, n), star(rng, dx, dy, 2.5, m)
    want = star_area(((0, 0), a), ((dx, dy), b))
    got = G.shared_areas(edges([[a], [a], [b]]), edges([[b], [a[::-1]], [b]]))
    assert abs(got[0] - want) < 1e-9
    assert abs(got[1] + abs(G.ring_areas([np.array(a)]))) < 1e-9 and abs(got[2] - G.ring_areas([np.array(b)])) < 1e-9  # a ring turned round counts less


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 30), st.sampled_from([1, 7, 64]))
def test_parts_make_up_the_polygon_and_are_bounded(seed, n, most):
    rng = random.Random(seed)
    x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
    ring, hole = np.array(star(rng, x, y, 100, n)), np.array(star(rng, x, y, 2, 5))[::-1]
    parts = list(G.parts_of([ring, hole], 3.0, 7, most))
    assert abs(sum(G.ring_areas(p[4]) for p in parts) - G.ring_areas([ring, hole])) < 1e-6
    assert len(parts) <= max(most, 4) and len({p[:3] for p in parts}) == len(parts)
    for level, cx, cy, whole, held in parts:
        side, every = 3.0 * 2**level, np.concatenate(held)
        assert (every >= np.array([cx, cy]) * side - 1e-9).all() and (every <= np.array([cx + 1, cy + 1]) * side + 1e-9).all()
        assert whole == (abs(G.ring_areas(held) - side**2) < 1e-9 * side**2)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 200))
def test_rings_of_few_and_many_points_are_cut_alike(seed, n):
    rng = random.Random(seed)
    ring, box = np.array(star(rng, 0, 0, 10, n)), (rng.uniform(-9, 0), rng.uniform(-9, 0), rng.uniform(0, 9), rng.uniform(0, 9))
    many = ring
    for axis, edge, less in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        many = G.clipped(many, axis, edge, less)
    few = G.clipped_to_box([ring], box)
    assert abs(G.ring_areas(few) - G.ring_areas([many])) < 1e-9
    corners = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
    want = sum(convex_area([(0.0, 0.0), *e], corners) for e in zip(map(tuple, ring), map(tuple, np.roll(ring, -1, axis=0)), strict=True))
    assert abs(G.ring_areas(few) - want) < 1e-6


@pytest.fixture(scope="module")
def shapes():
    """Stars of sizes from 1 to 1000, some with a hole or a second part: (key, polygons, stars with signs)."""
    rng = random.Random(3)
    out = []
    for k in range(40):
        r = 10 ** rng.uniform(0, 3)
        x, y = rng.uniform(-800, 800), rng.uniform(-800, 800)
        outer = star(rng, x, y, r, rng.randint(4, 14))
        polygons, signed = [[outer]], [(1, (x, y), outer)]
        if k % 3 == 0:  # stars keep 0.3 of their radius clear, and its edges a part of that
            hole = star(rng, x, y, 0.02 * r, 5)
            polygons[0].append(hole[:: rng.choice([1, -1])])
            signed.append((-1, (x, y), hole))
        if k % 4 == 0:
            far = star(rng, x + 3 * r, y, r / 2, 6)
            polygons.append([[*far, far[0]][::-1]])  # closed, and the other way round
            signed.append((1, (x + 3 * r, y), far))
        out.append((k, polygons, signed))
    return out


def frame(spark, shapes):
    return spark.createDataFrame([(k, polygons) for k, polygons, _ in shapes], f"key long, geometry {G.GEOMETRY}")


@pytest.mark.parametrize("most", [1, 64])
def test_overlaps_of_polygons_of_all_sizes(spark, shapes, most):
    a, b = shapes[:20], shapes[20:]
    want = {(k, m): sum(s * t * star_area((c, r), (d, q)) for s, c, r in x for t, d, q in y) for k, _, x in a for m, _, y in b}
    got = {(r.src, r.dst): r.area for r in P.polygon_overlaps(frame(spark, a), frame(spark, b), 5.0, most).collect()}
    assert got.keys() == {k for k, v in want.items() if v > 1e-9}
    assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in got)


def test_rows_of_a_shape_are_bounded_whatever_its_size(spark, shapes):
    df = frame(spark, shapes).select("key", G.signed_rings(F.col("geometry")).alias("rings"))
    boxes = df.select("key", *G.bounds(F.col("rings")))
    assert P.with_cells(P.with_level(boxes, 5.0), 5.0).groupBy("key").count().agg(F.max("count")).first()[0] <= 4
    assert P.polygon_parts(df, 5.0, 64).groupBy("dst").count().agg(F.max("count")).first()[0] <= 64


def test_areas_are_conserved_over_a_partition(spark):
    rng = random.Random(8)
    grid = spark.createDataFrame([(k, float(k % 9) * 50 - 200, float(k // 9) * 50 - 200, float(k % 9) * 50 - 150, float(k // 9) * 50 - 150) for k in range(81)], BOX)
    rings = [(k, [[star(rng, rng.uniform(-60, 60), rng.uniform(-60, 60), 130, 9)]]) for k in range(12)]
    shapes = spark.createDataFrame(rings, f"key long, geometry {G.GEOMETRY}")
    whole = {r.key: r.a for r in shapes.select("key", G.area(F.col("geometry")).alias("a")).collect()}
    for got in (P.polygon_overlaps(shapes, P.box_geometry(grid), 20.0).groupBy(F.col("src").alias("k")), P.polygon_overlaps(P.box_geometry(grid), shapes, 20.0).groupBy(F.col("dst").alias("k"))):
        sums = {r.k: r.a for r in got.agg(F.sum("area").alias("a")).collect()}
        assert all(abs(sums[k] - whole[k]) < 1e-6 for k in whole)


def test_boxes_of_all_sizes_overlap_once(spark):
    rng = random.Random(4)
    boxes = [(k, x := rng.uniform(-900, 900), y := rng.uniform(-900, 900), x + 10 ** rng.uniform(0, 3), y + 10 ** rng.uniform(0, 3)) for k in range(90)]
    want = {(a[0], b[0]): (min(a[3], b[3]) - max(a[1], b[1])) * (min(a[4], b[4]) - max(a[2], b[2])) for a in boxes[:45] for b in boxes[45:] if min(a[3], b[3]) > max(a[1], b[1]) and min(a[4], b[4]) > max(a[2], b[2])}
    got = P.box_overlaps(spark.createDataFrame(boxes[:45], BOX), spark.createDataFrame(boxes[45:], BOX), 4.0).collect()
    assert len(got) == len(want) and all(abs(want[r.src, r.dst] - r.area) < 1e-6 for r in got)


def test_points_in_and_near_polygons(spark, shapes):
    rng = random.Random(6)
    points = [(i, f"c{i % 3}", rng.uniform(-1200, 1200), rng.uniform(-1200, 1200)) for i in range(400)]

    def far(p, q, x, y):
        dx, dy = q[0] - p[0], q[1] - p[1]
        t = min(1, max(0, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(x - p[0] - t * dx, y - p[1] - t * dy)

    want = set()
    for k, polygons, _ in shapes:
        rings = [r for p in polygons for r in p]
        lines = [e for r in rings for e in zip(r, r[1:] + r[:1], strict=True)]
        for i, _, x, y in points:
            odd = sum((p[1] <= y) != (q[1] <= y) and x < p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for p, q in lines) % 2
            if odd or min(far(p, q, x, y) for p, q in lines) <= 30:
                want.add((k, i))
    got = P.points_near_polygons(frame(spark, shapes), spark.createDataFrame(points, "id long, code string, x double, y double"), 30.0, 40.0, 32).collect()
    assert len(got) == len(want) and {(r.key, r.id) for r in got} == want


def test_null_and_empty_geometries_overlap_nothing(spark):
    odd = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]]])], f"key long, geometry {G.GEOMETRY}")
    assert [tuple(r) for r in P.polygon_overlaps(odd, odd, 2.0).collect()] == [(4, 4, 81.0)]
    assert P.points_near_polygons(odd, spark.createDataFrame([(1, "a", 5.0, 5.0), (2, "a", 20.0, 5.0)], "id long, code string, x double, y double"), 1.0, 2.0).count() == 1


def test_geojson_keeps_holes_and_parts(spark, tmp_path, shapes):
    df = frame(spark, shapes)
    geojson.write_features(df, f"{tmp_path}/g")
    back = geojson.read_features(spark, f"{tmp_path}/g", "key: bigint")
    want = {k: sum(s * abs(G.ring_areas([np.array(r)])) for s, _, r in signed) for k, _, signed in shapes}
    got = {r.key: (r.kind, r.a) for r in back.select("key", "kind", G.area(F.col("geometry")).alias("a")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][1] - want[k]) < 1e-6 * want[k] for k in want)
    assert {k for k, v in got.items() if v[0] == "MultiPolygon"} == {k for k, p, _ in shapes if len(p) > 1}
    texts = [r.value for r in spark.read.text(f"{tmp_path}/g").collect()]
    collection = tmp_path / "c.json"
    collection.write_text('{"type": "FeatureCollection", "features": [' + ",".join([*texts, '{"type": "Feature", "properties": {"key": 99}, "geometry": {"type": "Point", "coordinates": [1, 2]}}']) + "]}")
    whole = geojson.read_features(spark, str(collection), "key: bigint", collection=True)
    assert whole.count() == len(shapes) + 1 and whole.where("geometry is null").first().key == 99
    rings = back.select("geometry").first().geometry[0]
    assert all((r[0].x, r[0].y) == (r[-1].x, r[-1].y) for r in rings)


def test_any_callable_aggregates(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0), (1, None, 9.0), (1, 2.0, 3.0), (2, None, 1.0)], "dst long, v double, area double")
    both = df.withColumn("w", F.col("v"))
    how = {"v": P.reducer(lambda v, a: float(np.average(v, weights=a)), "area"), "w": lambda c: F.max(c) - F.min(c)}
    got = {r.dst: (r.v, r.w) for r in P.perform_aggregation(both, ["v", "w"], how, "dst").collect()}
    assert got == {1: (2.5, 2.0), 2: (None, None)}
    assert P.perform_aggregation(df, ["v"], P.reducer(np.median), "dst").where("dst = 1").first().v == 3.0
