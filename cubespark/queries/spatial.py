"""Overlaps, buffers, re-gridding, amenities and noise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions.scalars import log10_plus_one, rounded
from cubespark.operators import geometry as G
from cubespark.operators import income as N
from cubespark.operators import spatial as P
from cubespark.operators.indices import night_index
from cubespark.queries.base import (
    AMENITY, CELL_CUBE, COMMUNES, CUBE, DAILY, NIGHT, NSI, OVERLAP, TILES, amenities, boxes, cell_boxes, cell_cube, communes, cube, frequent,
    open_at_night, query, table, tile_boxes,
)
from cubespark.sources.store import write_bucketed

BUCKET = 250.0
R = rounded


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.box_overlaps(cell_boxes(spark, sf_dir), tile_boxes(spark, sf_dir), BUCKET)


@query(f"with {OVERLAP} select src, dst, round(area, 6) + 0 area from ov")
def spatial_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark, sf_dir).select("src", "dst", R(F.col("area")).alias("area"))


def octagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ring): the tiles with their corners cut off at a quarter of the side."""
    x0, y0, x1, y1 = (F.col(c) for c in P.BOX)
    corners = [(x0 + 50, y0), (x1 - 50, y0), (x1, y0 + 50), (x1, y1 - 50), (x1 - 50, y1), (x0 + 50, y1), (x0, y1 - 50), (x0, y0 + 50)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    return tile_boxes(spark, sf_dir).select("key", ring.alias("ring"))


# What a corner's triangle (legs of 50) takes from a box that spans u..a and v..b along the legs is a difference of squares.
@query(
    f"""with {OVERLAP}, b as (select ov.*, greatest(c.x0, t.x0) - t.x0 l, least(c.x0 + 100, t.x0 + 200) - t.x0 r, greatest(c.y0, t.y0) - t.y0 d, least(c.y0 + 100, t.y0 + 200) - t.y0 u
  from ov join cell_geo c on c.key = src join tile_geo t on t.key = dst),
k as (select src, dst, area, unnest([[l, r, d, u], [200 - r, 200 - l, d, u], [l, r, 200 - u, 200 - d], [200 - r, 200 - l, 200 - u, 200 - d]]) q from b),
t as (select src, dst, area, q[1] u, q[2] a, q[3] v, q[4] b from k),
cutoff as (select src, dst, any_value(area) area, sum((greatest(0, 50 - u - v) ** 2 - greatest(0, 50 - a - v) ** 2 - greatest(0, 50 - u - b) ** 2 + greatest(0, 50 - a - b) ** 2) / 2) c from t group by 1, 2)
select src, dst, round(area - c, 6) + 0 area from cutoff where area - c > 0"""
)
def spatial_overlap_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ring_overlaps(cell_boxes(spark, sf_dir), octagons(spark, sf_dir), BUCKET).select("src", "dst", R(F.col("area")).alias("area"))


def diamonds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Squares on their corners, as (key, geometry): small ones of parts, and of suppliers from 25 to 25,000 metres."""

    def of(t: DataFrame, x, y, r) -> DataFrame:
        ring = F.array(G.point(x + r, y), G.point(x, y + r), G.point(x - r, y), G.point(x, y - r))
        return t.select("key", G.of_ring(ring).alias("geometry"))

    k = F.col("key")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    radius = F.when(k % 40 == 0, 25_000).when(k % 4 == 0, 250).otherwise(25)
    return of(parts, 100 * (k % 20) + 87, 100 * F.floor(k / 20) + 111, 30 + k % 50), of(suppliers, 450 * (k % 5), 450 * F.floor(k / 5), radius)


# Turned by 45 degrees they are boxes, in coordinates that stretch areas by two.
@query(
    """with a as (select p_partkey key, 100 * (p_partkey % 20) + 87 x, 100 * floor(p_partkey / 20) + 111 y, 30 + p_partkey % 50 r from part),
b as (select s_suppkey key, 450 * (s_suppkey % 5) x, 450 * floor(s_suppkey / 5) y, case when s_suppkey % 40 = 0 then 25000 when s_suppkey % 4 = 0 then 250 else 25 end r from supplier),
o as (select a.key src, b.key dst, least(a.x + a.y + a.r, b.x + b.y + b.r) - greatest(a.x + a.y - a.r, b.x + b.y - b.r) u,
  least(a.x - a.y + a.r, b.x - b.y + b.r) - greatest(a.x - a.y - a.r, b.x - b.y - b.r) v from a, b)
select src, dst, round(u * v / 2, 5) area from o where u > 0 and v > 0"""
)
def spatial_overlap_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon on polygon, of sizes from 1 to 1000."""
    return P.polygon_overlaps(*diamonds(spark, sf_dir), 100.0).select("src", "dst", R(F.col("area"), 5).alias("area"))


def iris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, geometry): the tiles without their upper right quarters, which are concave."""
    x, y = F.col("xmin"), F.col("ymin")
    corners = [(x, y), (x + 200, y), (x + 200, y + 100), (x + 100, y + 100), (x + 100, y + 200), (x, y + 200)]
    return tile_boxes(spark, sf_dir).select("key", G.of_ring(F.array(*[G.point(*c) for c in corners])).alias("geometry"))


#: As boxes that count with a sign; what two regions share is a sum over pairs of boxes.
IRIS = f"""{TILES}, iris_box as (select key, 1 s, x0, y0, x0 + 200 x1, y0 + 200 y1 from tile_geo union all select key, -1, x0 + 100, y0 + 100, x0 + 200, y0 + 200 from tile_geo)"""


def _signed_sql(a: str, b: str, name: str) -> str:
    return f"""{name} as (select a.key src, b.key dst, sum(a.s * b.s * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) area
  from {a} a join {b} b on a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1 group by 1, 2 having area > 1e-9)"""


@query(
    f"""with {IRIS}, {COMMUNES}, {_signed_sql('iris_box', 'commune_box', 'ov')}, u as (select key dst, sum(s * (x1 - x0) * (y1 - y0)) unit from commune_box group by 1)
select dst, round(sum(c_acctbal * area) / sum(area), 6) balance, round(sum(area) / any_value(unit), 6) covered from ov join customer on c_custkey = src join u using (dst)
group by 1 having sum(area) / any_value(unit) > 0.5"""
)
def regrid_iris_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave units to communes with holes and exclaves, by the areas that they share."""
    whole = communes(spark, sf_dir)
    pairs = P.polygon_overlaps(iris(spark, sf_dir), whole, BUCKET)
    areas = whole.select(F.col("key").alias("dst"), G.area(F.col("geometry")).alias("unit_area"))
    values = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.col("c_acctbal").alias("balance"))
    got = P.regrid(values, pairs, areas, ["balance"], "weighted_mean", least=0.5).join(P.covered_share(pairs, areas), "dst")
    return got.select("dst", R(F.col("balance")).alias("balance"), R(F.col("covered")).alias("covered"))


def _count_sql(where: str, radius: int, name: str) -> str:
    return f"""{name} as (select key tile, count(code) n from tile_geo left join am on {where}
  and greatest(x0 - x, 0, x - x0 - 200) ** 2 + greatest(y0 - y, 0, y - y0 - 200) ** 2 <= {radius} ** 2 group by 1)"""


@query(
    f"""with {TILES}, {AMENITY}, {_count_sql('true', 200, 'a')}, {_count_sql(DAILY, 200, 'f')}, {_count_sql(NIGHT, 200, 'o')}
select tile, round(log2(1 + a.n), 6) log2_all, round(log2(1 + f.n), 6) log2_frequent, round(log2(1 + o.n), 6) log2_night from a join f using (tile) join o using (tile)"""
)
def amenity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, a = tile_boxes(spark, sf_dir), amenities(spark, sf_dir)
    every = N.amenity_counts(t, a, 200, BUCKET, "log2_all")
    daily = N.amenity_counts(t, a, 200, BUCKET, "log2_frequent", frequent())
    night = N.amenity_counts(t, a, 200, BUCKET, "log2_night", open_at_night())
    return every.join(daily, "tile").join(night, "tile").select("tile", *[R(F.col(c)).alias(c) for c in ("log2_all", "log2_frequent", "log2_night")])


@query(f"with {TILES}, {AMENITY}, {_count_sql('true', 500, 'a')} select tile, n, round(log10(1 + n), 6) log10_count from a")
def amenity_log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tile_boxes(spark, sf_dir)
    n = P.points_in_buffer(t, amenities(spark, sf_dir), 500, BUCKET).groupBy("key").agg(F.count("*").alias("n"))
    rows = t.select("key").join(n, "key", "left").select(F.col("key").alias("tile"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.select("tile", "n", R(log10_plus_one(F.col("n"))).alias("log10_count"))


# Corners in turn, from the lower left; a point is inside if it is left of all sides.
@query(
    f"""with {TILES}, {AMENITY}, near as (select key, row_number() over () id, code, x - x0 x, y - y0 y from tile_geo join am on x between x0 - 200 and x0 + 400 and y between y0 - 200 and y0 + 400),
side as (select unnest([50, 150, 200, 200, 150, 50, 0, 0]) ax, unnest([0, 0, 50, 150, 200, 200, 150, 50]) ay, unnest([150, 200, 200, 150, 50, 0, 0, 50]) bx, unnest([0, 50, 150, 200, 200, 150, 50, 0]) by_),
d as (select key, id, code, x, y, ax, ay, bx - ax dx, by_ - ay dy, least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) t from near, side),
e as (select key, id, code from d group by 1, 2, 3 having min(dx * (y - ay) - dy * (x - ax)) > 0 or min((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) <= 40000),
n as (select key, count(*) n, count(*) filter (where {NIGHT}) o from e group by 1)
select key tile, round(log2(1 + coalesce(n, 0)), 6) log2_all, round(log2(1 + coalesce(o, 0)), 6) log2_night from tile_geo left join n using (key)"""
)
def amenity_counts_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amenities within 200 metres of the octagons themselves."""
    shapes = octagons(spark, sf_dir).select("key", G.of_ring(F.col("ring")).alias("geometry"))
    got = N.amenity_counts_near(shapes, amenities(spark, sf_dir), 200, BUCKET, log2_all=None, log2_night=open_at_night())
    return got.select("tile", *[R(F.col(c)).alias(c) for c in ("log2_all", "log2_night")])


@query(
    f"""with {CUBE}, {TILES}, {AMENITY}, {_count_sql(NIGHT, 200, 'o')}
select tile, count(*) n, round(sum(v), 6) + 0 as value from cube where tile in (select tile from o where log2(1 + n) <= 1) group by 1"""
)
def amenity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = N.amenity_counts(tile_boxes(spark, sf_dir), amenities(spark, sf_dir), 200, BUCKET, codes=open_at_night())
    kept = N.without_busy_nights(cube(spark, sf_dir), counts, 1)
    return kept.groupBy("tile").agg(F.count("*").alias("n"), R(F.sum("value")).alias("value"))


#: The pairs of threshold and buffer, and the tiles that each leaves out, once.
SAMPLES = f"""pairs(threshold, buffer_m) as (values {', '.join(str(p) for p in N.THRESHOLDS_AND_BUFFERS)}),
near as (select key tile, buffer_m, count(code) n from (select distinct buffer_m from pairs) cross join tile_geo left join am on {NIGHT}
  and greatest(x0 - x, 0, x - x0 - 200) ** 2 + greatest(y0 - y, 0, y - y0 - 200) ** 2 <= buffer_m ** 2 group by 1, 2),
samples as (select threshold, buffer_m, cube.* from pairs join near using (buffer_m) join cube using (tile) where log2(1 + n) <= threshold)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.amenity_samples(cube(spark, sf_dir), tile_boxes(spark, sf_dir), amenities(spark, sf_dir), BUCKET, open_at_night())


@query(f"with {CUBE}, {TILES}, {AMENITY}, {SAMPLES} select threshold, buffer_m, count(distinct tile) tiles, round(sum(v), 6) + 0 as value from samples group by 1, 2")
def amenity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("threshold", "buffer_m").agg(F.countDistinct("tile").alias("tiles"), R(F.sum("value")).alias("value"))


def noise_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    zone = boxes(s, 450 * (k % 5), 450 * F.floor(k / 5), 500.0)
    return zone.withColumn("noise_estimate", (40 + k % 30).cast("double"))


NOISE = """zone as (select s_suppkey key, 450.0 * (s_suppkey % 5) x0, 450.0 * floor(s_suppkey / 5) y0, 40 + s_suppkey % 30 noise from supplier),
nz as (select t.key tile, sum(noise * a) / sum(a) noise from (select t.key, noise,
  (least(z.x0 + 500, t.x0 + 200) - greatest(z.x0, t.x0)) * (least(z.y0 + 500, t.y0 + 200) - greatest(z.y0, t.y0)) a
  from zone z join tile_geo t on z.x0 < t.x0 + 200 and t.x0 < z.x0 + 500 and z.y0 < t.y0 + 200 and t.y0 < z.y0 + 500) t group by 1)"""


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, noise_estimate): the mean of the zones' estimates, weighted by overlap."""
    zones = noise_zones(spark, sf_dir)
    pairs = P.box_overlaps(zones.drop("noise_estimate"), tile_boxes(spark, sf_dir), 500.0)
    joined = pairs.join(zones.select(F.col("key").alias("src"), "noise_estimate"), "src")
    return P.perform_aggregation(joined, ["noise_estimate"], "weighted_mean", "dst").withColumnRenamed("dst", "tile")


@query(f"with {TILES}, {NOISE} select tile, round(noise, 6) noise_estimate from nz")
def zonal_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(spark, sf_dir).select("tile", R(F.col("noise_estimate")).alias("noise_estimate"))


@query(
    f"""with {IRIS}, {COMMUNES}, {_signed_sql('commune_box', 'iris_box', 'ov')}
select dst iris, round(sum((40 + src % 30) * area) / sum(area), 6) noise_estimate from ov group by 1"""
)
def zonal_noise_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with holes and parts over concave units."""
    zones = communes(spark, sf_dir).withColumn("noise_estimate", (40 + F.col("key") % 30).cast("double"))
    got = N.zonal_mean(zones, iris(spark, sf_dir), "noise_estimate", BUCKET)
    return got.select(F.col("key").alias("iris"), R(F.col("noise_estimate")).alias("noise_estimate"))


@query(f"with {CUBE}, {NSI}, {TILES}, {NOISE} select city, tile, round(nsi, 6) + 0 night_index, round(noise, 6) noise_estimate from nsi join nz using (tile)")
def nsi_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = night_index(cube(spark, sf_dir), "tile").join(noise(spark, sf_dir), "tile")
    return got.select("city", "tile", R(F.col("night_index")).alias("night_index"), R(F.col("noise_estimate")).alias("noise_estimate"))


@query(
    f"""with {CUBE}, {NSI}, {TILES}, {AMENITY}, {_count_sql('true', 500, 'a')}, {_count_sql(DAILY, 500, 'f')}
select city, tile, round(nsi, 6) + 0 night_index, round(log2(1 + a.n), 6) log2_all, round(log2(1 + f.n), 6) log2_frequent from nsi join a using (tile) join f using (tile)"""
)
def nsi_amenity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, a = tile_boxes(spark, sf_dir), amenities(spark, sf_dir)
    got = night_index(cube(spark, sf_dir), "tile").join(N.amenity_counts(t, a, 500, BUCKET, "log2_all"), "tile")
    got = got.join(N.amenity_counts(t, a, 500, BUCKET, "log2_frequent", frequent()), "tile")
    return got.select("city", "tile", *[R(F.col(c)).alias(c) for c in ("night_index", "log2_all", "log2_frequent")])


def priced_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return overlaps(spark, sf_dir).join(price, "src")


PRICED = f"{OVERLAP}, priced as (select src, dst, area, p_retailprice price, p_size size from ov join part on src = p_partkey)"


@query(f"with {PRICED} select dst, round(sum(price * area) / sum(area), 6) price from priced group by 1")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_overlaps(spark, sf_dir).groupBy("dst").agg(R(P.weighted_mean("price")).alias("price"))


@query(f"with {PRICED} select dst, round(sum(price * area / 10000), 6) price from priced group by 1")
def weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_overlaps(spark, sf_dir).groupBy("dst").agg(R(P.weighted_sum("price", 10_000)).alias("price"))


@query(f"with {PRICED} select dst, round(sum(price * area) / sum(area), 6) price, round(sum(size * area / 10000), 6) size, round(max(area), 6) area from priced group by 1")
def perform_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced_overlaps(spark, sf_dir).withColumn("largest", F.col("area"))
    got = P.perform_aggregation(rows, ["price", "size", "largest"], {"price": "weighted_mean", "size": "weighted_sum", "largest": "max"}, "dst")
    return got.select("dst", R(F.col("price")).alias("price"), R(F.col("size")).alias("size"), R(F.col("largest")).alias("area"))


@query(
    f"""with {PRICED}, w as (select *, sum(area) over (partition by dst order by price, src rows unbounded preceding) upto, sum(area) over (partition by dst) every from priced),
m as (select dst, min(price) median from w where 2 * upto >= every group by 1)
select dst, round(median, 6) price, round(max(size) - min(size), 6) size from priced join m using (dst) group by 1, median"""
)
def perform_aggregation_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function of values and weights, and one of columns: the area-weighted median, and the range."""

    def weighted_median(value: np.ndarray, area: np.ndarray) -> float:
        order = np.argsort(value, kind="stable")
        return value[order][np.searchsorted(2 * np.cumsum(area[order]), area.sum())]

    how = {"price": P.reducer(weighted_median, "area"), "size": lambda c: F.max(c) - F.min(c)}
    got = P.perform_aggregation(priced_overlaps(spark, sf_dir), ["price", "size"], how, "dst")
    return got.select("dst", R(F.col("price")).alias("price"), R(F.col("size")).alias("size"))


@query(f"with {OVERLAP} select dst, round(sum(area) / 40000, 6) covered from ov group by 1 having sum(area) / 40000 > 0.8")
def covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.covered_share(overlaps(spark, sf_dir), 40_000.0).where("covered > 0.8")
    return got.select("dst", R(F.col("covered")).alias("covered"))


@query(f"with {PRICED} select dst, round(sum(price * area) / sum(area), 6) price, round(sum(size * area / 10000), 6) size from priced group by 1 having sum(area) / 40000 > 0.8")
def regrid_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    got = P.regrid(values, overlaps(spark, sf_dir), 40_000.0, ["price", "size"], {"price": "weighted_mean", "size": "weighted_sum"})
    return got.select("dst", R(F.col("price")).alias("price"), R(F.col("size")).alias("size"))


@query(
    f"""with {OVERLAP.split(', ov as')[0]}, commune as (select s_suppkey key, 700.0 * (s_suppkey % 3) x0, 400.0 * floor(s_suppkey / 3) y0 from supplier),
ov as (select c.key src, t.key dst, (least(c.x0 + 100, t.x0 + 700) - greatest(c.x0, t.x0)) * (least(c.y0 + 100, t.y0 + 400) - greatest(c.y0, t.y0)) area
  from cell_geo c join commune t on c.x0 < t.x0 + 700 and t.x0 < c.x0 + 100 and c.y0 < t.y0 + 400 and t.y0 < c.y0 + 100)
select dst, round(sum(p_retailprice * area) / sum(area), 6) price from ov join part on src = p_partkey group by 1 having sum(area) / 280000 > 0.8"""
)
def regrid_commune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to rectangular communes of 700 by 400 metres, whose area is a column."""
    k = F.col("s_suppkey")
    x, y = (700 * (k % 3)).cast("double"), (400 * F.floor(k / 3)).cast("double")
    communes = table(spark, sf_dir, "supplier").select(k.alias("key"), x.alias("xmin"), y.alias("ymin"), (x + 700).alias("xmax"), (y + 400).alias("ymax"))
    areas = communes.select(F.col("key").alias("dst"), ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("unit_area"))
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("price"))
    got = P.regrid(values, P.box_overlaps(cell_boxes(spark, sf_dir), communes, BUCKET), areas, ["price"], "weighted_mean")
    return got.select("dst", R(F.col("price")).alias("price"))


REGRID_CUBE = f"""with {OVERLAP}, {CELL_CUBE}, good as (select dst from ov group by 1 having sum(area) / 40000 > 0.8)
select dst tile, service, slot, round(sum(v * area / 10000), 6) + 0 as value from cell_cube join ov using (src) join good using (dst) group by 1, 2, 3"""


@query(REGRID_CUBE)
def regrid_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.regrid(cell_cube(spark, sf_dir), overlaps(spark, sf_dir), 40_000.0, ["value"], "weighted_sum", "service", "slot")
    return got.select(F.col("dst").alias("tile"), "service", "slot", R(F.col("value")).alias("value"))


#: Rows of the line items for a bucket, of which a task sorts one; and the least number of them.
BUCKET_ROWS, BUCKETS = 500_000, 8


@query(REGRID_CUBE)
def regrid_cube_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tables that are stored once, by cell."""
    buckets = max(BUCKETS, -(-table(spark, sf_dir, "lineitem").count() // BUCKET_ROWS))
    cells = write_bucketed(cell_cube(spark, sf_dir), "cells", "src", buckets)
    ways = write_bucketed(P.bridge(overlaps(spark, sf_dir), 40_000.0), "bridge", "src", buckets)
    got = P.regrid_stored(cells, ways, ["value"], "weighted_sum", "service", "slot")
    return got.select(F.col("dst").alias("tile"), "service", "slot", R(F.col("value")).alias("value"))
