"""Polygons with holes and several parts, without a geometry library.

A geometry is an array of polygons, each an array of rings (the outer one first, then its holes), each an array of points (x, y), closed
or not. For computing it becomes signed rings: outer rings run counter-clockwise and holes clockwise. Everything then adds up
over rings, and over their edges: the region is the sum, with signs, of what lies below each edge down to a base line. So the area that
two regions share is the sum over pairs of edges of the integral of the lesser of both heights, whatever the shapes are (concave, with
holes, of several parts); overlapping parts of one geometry count as often as they overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"
RINGS = f"array<{POINTS}>"
GEOMETRY = f"array<{RINGS}>"
#: Pairs of edges that are worked on at once.
EDGE_PAIRS = 1 << 20


# -- columns -----------------------------------------------------------------------------------------------------------


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The ring of a box, counter-clockwise."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def of_ring(ring: Column) -> Column:
    """The geometry of one simple ring."""
    return F.array(F.array(ring))


def signed_ring_area(ring: Column) -> Column:
    """Positive for a counter-clockwise ring."""
    n = F.size(ring)
    cross = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, c: a + c) / 2


def signed_rings(geometry: Column) -> Column:
    """All rings of a geometry, the outer ones counter-clockwise and the holes clockwise."""

    def turned(ring: Column, i: Column) -> Column:
        return F.when((signed_ring_area(ring) >= 0) == (i == 0), ring).otherwise(F.reverse(ring))

    return F.flatten(F.transform(geometry, lambda polygon: F.transform(polygon, turned)))


def rings_area(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, signed_ring_area), F.lit(0.0), lambda a, c: a + c)


def area(geometry: Column) -> Column:
    """The area of a geometry, without its holes."""
    return rings_area(signed_rings(geometry))


def bounds(rings: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax of rings."""
    points = F.flatten(rings)
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax")]


def winding(rings: Column, x: Column, y: Column) -> Column:
    """How often signed rings go round a point: 1 inside, 0 outside and in holes. Points on an edge may count as either."""

    def of(ring: Column) -> Column:
        n = F.size(ring)

        def crossing(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % n)
            left = (q["x"] - p["x"]) * (y - p["y"]) - (x - p["x"]) * (q["y"] - p["y"])
            up, down = (p["y"] <= y) & (q["y"] > y) & (left > 0), (p["y"] > y) & (q["y"] <= y) & (left < 0)
            return F.when(up, 1).when(down, -1).otherwise(0)

        return F.aggregate(F.transform(ring, crossing), F.lit(0), lambda a, c: a + c)

    return F.aggregate(F.transform(rings, of), F.lit(0), lambda a, c: a + c)


def segment_distance2(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column) -> Column:
    """The squared distance of a point to a segment, which may be a point."""
    dx, dy = x1 - x0, y1 - y0
    along = F.coalesce(F.try_divide((x - x0) * dx + (y - y0) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - x0 - t * dx, y - y0 - t * dy
    return ex * ex + ey * ey


# -- numpy, inside Arrow tasks -----------------------------------------------------------------------------------------


def arrays_of(rings: pa.ListArray) -> list[list[np.ndarray]]:
    """Each row's rings as arrays of points (n x 2)."""
    of_row, of_ring = rings.value_lengths().to_numpy(), rings.flatten()
    points = of_ring.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1).astype(float)
    each = np.split(xy, np.cumsum(of_ring.value_lengths().to_numpy())[:-1]) if len(of_ring) else []
    ends = np.concatenate(([0], np.cumsum(of_row)))
    return [each[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def rings_of(rows: list[list[np.ndarray]]) -> pa.ListArray:
    """The other way round."""
    rings = [ring for row in rows for ring in row]
    x, y = np.concatenate([np.zeros((0, 2)), *rings]).T
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)), pa.array(np.ascontiguousarray(y))], ["x", "y"])

    def ends(sizes: list[int]) -> pa.Array:
        return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))

    return pa.ListArray.from_arrays(ends([len(row) for row in rows]), pa.ListArray.from_arrays(ends([len(r) for r in rings]), points))


class Edges:
    """The edges of a column of signed rings, row after row: ends (x0, y0) and (x1, y1), and where each row's edges begin."""

    def __init__(self, rings: pa.ListArray):
        of_row, of_ring = rings.value_lengths().to_numpy(), rings.flatten()
        size, points = of_ring.value_lengths().to_numpy(), of_ring.flatten()
        self.x0, self.y0 = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        follows = np.arange(1, len(self.x0) + 1)
        end = np.cumsum(size)
        follows[end[size > 0] - 1] = (end - size)[size > 0]
        self.x1, self.y1 = self.x0[follows], self.y0[follows]
        ends = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(of_row)))]
        self.begin, self.count = ends[:-1], np.diff(ends)


def shared_areas(a: Edges, b: Edges) -> np.ndarray:
    """The area that the regions of each row of ``a`` and ``b`` share."""
    pairs = a.count * b.count
    out, at = np.zeros(len(pairs)), 0
    total = np.concatenate(([0], np.cumsum(pairs)))
    base = np.array([min(a.y0[i : i + n].min(initial=np.inf), b.y0[j : j + m].min(initial=np.inf)) for i, n, j, m in zip(a.begin, a.count, b.begin, b.count, strict=True)])
    while at < len(pairs):  # as many rows as make EDGE_PAIRS, or one
        to = max(at + 1, int(np.searchsorted(total, total[at] + EDGE_PAIRS, "right")) - 1)
        row = np.repeat(np.arange(at, to), pairs[at:to])
        k = np.arange(len(row)) - np.repeat(total[at:to] - total[at], pairs[at:to])
        out[at:to] = np.bincount(row - at, _below_both(a, a.begin[row] + k // b.count[row], b, b.begin[row] + k % b.count[row], base[row]), to - at)
        at = to
    return out


def _below_both(a: Edges, i: np.ndarray, b: Edges, j: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The signed area below the edges i and j and above ``base``."""
    out, ends = np.zeros(len(i)), []
    left = np.maximum(np.minimum(a.x0[i], a.x1[i]), np.minimum(b.x0[j], b.x1[j]))
    right = np.minimum(np.maximum(a.x0[i], a.x1[i]), np.maximum(b.x0[j], b.x1[j]))
    some = np.flatnonzero(right > left)
    i, j, left, right, base = i[some], j[some], left[some], right[some], base[some]
    for e, k in ((a, i), (b, j)):
        slope = (e.y1[k] - e.y0[k]) / (e.x1[k] - e.x0[k])
        ends.append([e.y0[k] + slope * (x - e.x0[k]) - base for x in (left, right)])
    (a0, a1), (b0, b1) = ends
    # The lesser of two heights is half of their sum less their distance, which changes its sign once at most.
    d0, d1 = np.abs(a0 - b0), np.abs(a1 - b1)
    apart = np.divide(d0 * d0 + d1 * d1, d0 + d1, out=np.zeros(len(some)), where=d0 + d1 > 0)
    apart = np.where((a0 - b0) * (a1 - b1) < 0, apart, d0 + d1)
    sign = np.sign(a.x0[i] - a.x1[i]) * np.sign(b.x0[j] - b.x1[j])
    out[some] = sign * (right - left) * (a0 + a1 + b0 + b1 - apart) / 4
    return out


def clipped(ring: np.ndarray, axis: int, edge: float, less: bool) -> np.ndarray:
    """The part of a ring (n x 2) on one side of a line, its direction kept; it may run along the line there and back."""
    if not len(ring):
        return ring
    x = ring[:, axis]
    inside = x <= edge if less else x >= edge
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    after, into = np.roll(ring, -1, axis=0), np.roll(inside, -1)
    cross = inside != into
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (edge - x) / (after[:, axis] - x)
        at = ring + t[:, None] * (after - ring)
    at[:, axis] = edge
    # Of each edge: where it crosses the line, then its end if that is inside.
    out = np.stack((at, after), axis=1).reshape(-1, 2)
    return out[np.stack((cross, into), axis=1).ravel()]


#: Points up to which a ring is cut point by point: below, calls of numpy take longer than the points.
FEW_POINTS = 64


def _clipped_few(ring: list[list[float]], axis: int, edge: float, less: bool) -> list[list[float]]:
    """clipped() for a ring of few points, given as lists."""
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        a, b = p[axis], q[axis]
        inside, into = (a <= edge, b <= edge) if less else (a >= edge, b >= edge)
        if inside != into:
            t = (edge - a) / (b - a)
            cross = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
            cross[axis] = edge
            out.append(cross)
        if into:
            out.append(q)
    return out


def clipped_to_box(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> list[np.ndarray]:
    out = []
    for ring in rings:
        (x0, y0), (x1, y1) = ring.min(axis=0).tolist(), ring.max(axis=0).tolist()
        sides = ((0, box[0], False, x0 < box[0]), (0, box[2], True, x1 > box[2]), (1, box[1], False, y0 < box[1]), (1, box[3], True, y1 > box[3]))
        if x1 <= box[0] or x0 >= box[2] or y1 <= box[1] or y0 >= box[3]:
            continue
        few = len(ring) <= FEW_POINTS
        cut = ring.tolist() if few else ring
        for axis, edge, less, crossed in sides:
            if crossed and len(cut):
                cut = _clipped_few(cut, axis, edge, less) if few else clipped(cut, axis, edge, less)
        if len(cut) > 2:
            out.append(np.array(cut) if few else cut)
    return out


def ring_areas(rings: list[np.ndarray]) -> float:
    """The signed area of rings."""
    total = 0.0
    for ring in rings:
        x, y = (ring - ring[0]).T
        total += float(x @ np.roll(y, -1) - np.roll(x, -1) @ y) / 2
    return total


def parts_of(rings: list[np.ndarray], base: float, level: int, most: int) -> Iterator[tuple[int, int, int, bool, list[np.ndarray]]]:
    """(level, column, row, whole, rings) of disjoint cells that make up a region, at most ``most`` of them, besides the few that the
    region touches at ``level``, where cells have the side base * 2 ** level.

    A cell that lies inside as a whole isn't divided further; one that an edge crosses is, the largest first, until there are enough, and
    has the part of the rings in it."""
    points = np.concatenate(rings) if rings else np.zeros((0, 2))
    if not len(points):
        return
    side = base * 2.0**level
    low, high = np.floor(points.min(axis=0) / side).astype(int), np.floor(points.max(axis=0) / side).astype(int)
    queue = [(level, cx, cy, rings) for cx in range(low[0], high[0] + 1) for cy in range(low[1], high[1] + 1)]
    crossed: list = []
    done = 0
    while queue:
        level, cx, cy, held = queue.pop(0)  # the coarsest first
        side = base * 2.0**level
        held = clipped_to_box(held, (cx * side, cy * side, (cx + 1) * side, (cy + 1) * side))
        covered = ring_areas(held) / side**2
        if abs(covered) < 1e-15:
            continue
        if abs(covered - 1) < 1e-12:
            corner = np.array([(cx, cy), (cx + 1, cy), (cx + 1, cy + 1), (cx, cy + 1)], float) * side
            yield level, cx, cy, True, [corner]
            done += 1
        elif level > 0 and done + len(crossed) + len(queue) + 4 <= most and sum(map(len, held)) > 4:
            queue += [(level - 1, 2 * cx + i, 2 * cy + j, held) for i in (0, 1) for j in (0, 1)]
        else:
            crossed.append((level, cx, cy, False, held))
    yield from crossed
