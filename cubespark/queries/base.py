"""The registry, and how the engine's tables are bound to the given ones: as DataFrames and as the same SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions.scalars import clock_of
from cubespark.operators.geometry import box_ring
from cubespark.operators.income import FREQUENT, OPEN_AT_NIGHT, log2_income, of_class
from cubespark.sources.store import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SERVICES = ("click", "error", "purchase", "signup", "view")
QS = [0.3, 0.7]
CLASSES = ("q0", "q1", "q2")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by region, customer, type and quarter hour, counted from 22:00."""
    e, c, n, r = (table(spark, sf_dir, t) for t in ("events", "customer", "nation", "region"))
    start = F.hour("ts") * 60 + F.floor(F.minute("ts") / 15) * 15
    rows = e.select("user_id", "event_type", "value", start.alias("m"))
    sums = rows.groupBy("user_id", "event_type", "m").agg(F.sum("value").alias("value"))
    placed = sums.join(c, sums.user_id == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return placed.select(
        F.col("r_name").alias("city"), F.col("user_id").alias("tile"), F.col("event_type").alias("service"),
        (F.pmod(F.col("m") + 120, F.lit(1440)) / 15).cast("int").alias("slot"), clock_of(F.col("m") * 60).alias("time"), "value",
    )


def stored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube, made once, for queries that use it more than once: it is far smaller than the events."""
    return cut_lineage(cube(spark, sf_dir))


CUBE = """cube as (
  select r_name city, user_id tile, event_type service,
    cast((extract(hour from ts) * 60 + floor(extract(minute from ts) / 15) * 15 + 120) % 1440 / 15 as int) slot,
    strftime(time_bucket(interval 15 minutes, ts), '%H:%M:%S') "time", sum(value) v
  from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by 1, 2, 3, 4, 5)"""


def admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("tile"), (F.col("c_acctbal") + 1000).alias("Ind_snv"), (1 + F.col("c_custkey") % 4).cast("double").alias("Ind"))


def incomes(spark: SparkSession, sf_dir: str, tiles: DataFrame) -> DataFrame:
    """log2 incomes of the tiles passed in."""
    return log2_income(admin(spark, sf_dir)).join(tiles.select("tile").distinct(), "tile")


INCOME = """inc as (select c_custkey tile, case when c_acctbal + 1000 > 0 then log2((c_acctbal + 1000) / (1 + c_custkey % 4)) end li
  from customer where c_custkey in (select tile from cube))"""

#: Income classes of the cube's tiles, pooled.
CLASS = (
    INCOME
    + """, cut as (select quantile_cont(li, 0.3) a, quantile_cont(li, 0.7) b from inc),
cls as (select tile, case when li <= a then 'q0' when li <= b then 'q1' else 'q2' end c from inc, cut where li is not null)"""
)

#: The night index by its definition: mean cumulative distribution less the unit's own, summed over the dense slots.
NSI = """sl as (select distinct slot from cube), tl as (select distinct city, tile from cube),
grid as (select city, tile, slot, coalesce(sum(v), 0) v from tl cross join sl left join cube using (city, tile, slot) group by 1, 2, 3),
pr as (select *, v / nullif(sum(v) over (partition by city, tile), 0) p from grid),
cdf as (select *, sum(p) over (partition by city, tile order by slot rows between unbounded preceding and current row) f from pr),
mf as (select city, slot, avg(f) m from cdf group by 1, 2),
nsi as (select city, tile, coalesce(sum(m - f), 0) nsi from cdf join mf using (city, slot) group by 1, 2)"""


def boxes(keyed: DataFrame, x, y, side: float) -> DataFrame:
    """(key, xmin, ymin, xmax, ymax) of squares with a lower left corner at (x, y)."""
    x, y = x.cast("double"), y.cast("double")
    return keyed.select("key", x.alias("xmin"), y.alias("ymin"), (x + side).alias("xmax"), (y + side).alias("ymax"))


def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    return boxes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), 200 * (k % 10), 200 * F.floor(k / 10), 200.0)


def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("key")
    return boxes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), 100 * (k % 20) + 37, 100 * F.floor(k / 20) + 61, 100.0)


TILES = """tile_geo as (select c_custkey key, 200.0 * (c_custkey % 10) x0, 200.0 * floor(c_custkey / 10) y0 from customer)"""
CELLS = """cell_geo as (select p_partkey key, 100.0 * (p_partkey % 20) + 37 x0, 100.0 * floor(p_partkey / 20) + 61 y0 from part)"""
OVERLAP = f"""{TILES}, {CELLS}, ov as (
  select c.key src, t.key dst, cast((least(c.x0 + 100, t.x0 + 200) - greatest(c.x0, t.x0)) * (least(c.y0 + 100, t.y0 + 200) - greatest(c.y0, t.y0)) as double) area
  from cell_geo c join tile_geo t on c.x0 < t.x0 + 200 and t.x0 < c.x0 + 100 and c.y0 < t.y0 + 200 and t.y0 < c.y0 + 100)"""


def communes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, geometry): boxes of 700 by 400, most with a hole, half of them with a part elsewhere."""
    k = F.col("s_suppkey")
    x, y = 700 * (k % 3), 400 * F.floor(k / 3)
    outer, hole, part = box_ring(x, y, x + 700, y + 400), box_ring(x + 100, y + 100, x + 250, y + 250), box_ring(x + 20, y + 5000, x + 120, y + 5100)
    main = F.when(k % 3 == 0, F.array(outer)).otherwise(F.array(outer, hole))
    geometry = F.when(k % 2 == 0, F.array(main, F.array(part))).otherwise(F.array(main))
    return table(spark, sf_dir, "supplier").select(k.alias("key"), geometry.alias("geometry"))


#: As boxes that count with a sign.
COMMUNES = """commune_box as (select s_suppkey key, 1 s, 700.0 * (s_suppkey % 3) x0, 400.0 * floor(s_suppkey / 3) y0, x0 + 700 x1, y0 + 400 y1 from supplier
  union all select s_suppkey, -1, 700.0 * (s_suppkey % 3) + 100 a, 400.0 * floor(s_suppkey / 3) + 100 b, a + 150, b + 150 from supplier where s_suppkey % 3 <> 0
  union all select s_suppkey, 1, 700.0 * (s_suppkey % 3) + 20 a, 400.0 * floor(s_suppkey / 3) + 5000 b, a + 100, b + 100 from supplier where s_suppkey % 2 = 0)"""


#: Codes of either class, and five of none.
CODES = (*sorted({*FREQUENT, *OPEN_AT_NIGHT}), "H101", "H102", "H103", "H104", "H105")


def amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.element_at(F.array(*map(F.lit, CODES)), (1 + k % len(CODES)).cast("int"))
    return table(spark, sf_dir, "part").select(
        code.alias("code"), (k * 7919 % 2000).cast("double").alias("x"), (k * 104729 % 120000).cast("double").alias("y")
    )


def open_at_night():
    return of_class("open_at_night")


def frequent():
    return of_class("frequent")


def _in(codes: tuple[str, ...]) -> str:
    return "code in (" + ", ".join(f"'{c}'" for c in codes) + ")"


AMENITY = f"""am as (select [{', '.join(f"'{c}'" for c in CODES)}][1 + p_partkey % {len(CODES)}] code, p_partkey * 7919 % 2000 x, p_partkey * 104729 % 120000 y from part)"""
NIGHT = _in(OPEN_AT_NIGHT)
DAILY = _in(FREQUENT)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value): quantities by supplier and brand."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = l.join(p, l.l_partkey == p.p_partkey)
    return joined.groupBy(F.col("l_suppkey").alias("row"), F.col("p_brand").alias("col")).agg(F.sum("l_quantity").alias("value"))


SALES = """sales as (select l_suppkey "row", p_brand col, sum(l_quantity) v from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def cell_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, service, slot, value): quantities by part, return flag and status, and month counted from October."""
    month = F.pmod(F.month("l_shipdate") - 10, F.lit(12)).cast("int")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("src"), F.concat("l_returnflag", "l_linestatus").alias("service"), month.alias("slot"))
        .agg(F.sum("l_quantity").alias("value"))
    )


CELL_CUBE = """cell_cube as (select l_partkey src, l_returnflag || l_linestatus service, cast((extract(month from l_shipdate) + 2) % 12 as int) slot,
  sum(l_quantity) v from lineitem group by 1, 2, 3)"""
