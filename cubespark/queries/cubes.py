"""Sources, filters, aggregations, windows and reshaping of cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions import scalars as S
from cubespark.operators import cube as C
from cubespark.operators import geometry as G
from cubespark.operators import income as N
from cubespark.operators.spatial import box_geometry
from cubespark.queries.base import COMMUNES, CUBE, INCOME, SALES, SERVICES, admin, communes, cube, incomes, query, sales, table, tile_boxes
from cubespark.sources import geojson, store, synthetic

R = S.rounded


@query(f"with {CUBE} select city, tile, service, slot, time, round(v, 6) + 0 as value from cube where city in ('ASIA', 'EUROPE')")
def cube_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.shared_path(spark, "cube")
    store.write_cube(cube(spark, sf_dir), path)
    c = store.load_cube(spark, path, ["ASIA", "EUROPE"])
    return c.select("city", "tile", "service", "slot", "time", R(F.col("value")).alias("value"))


@query("select lpad(cast(c_custkey as varchar), 8, '0') code, c_mktsegment segment, round(c_acctbal, 2) balance from customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.shared_path(spark, "csv")
    code = F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code")
    store.write_csv(table(spark, sf_dir, "customer").select(code, F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("balance")), path)
    return store.read_csv(spark, path, "code string, segment string, balance double")


@query("select c_custkey key, c_mktsegment segment, 5 points, 200.0 * (c_custkey % 10) + 200 xmax, 200.0 * floor(c_custkey / 10) ymin from customer")
def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.shared_path(spark, "geojson")
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    geojson.write_features(box_geometry(tile_boxes(spark, sf_dir)).join(segments, "key"), path)
    back = geojson.read_features(spark, path, "key: bigint, segment: string")
    ring = F.col("geometry")[0][0]
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return back.select("key", "segment", F.size(ring).alias("points"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"))


@query(
    f"""with {COMMUNES}, a as (select key, sum(s * (x1 - x0) * (y1 - y0)) area, count(*) filter (where s > 0) parts, count(*) filter (where s < 0) holes from commune_box group by 1)
select key, s_name "name", case when parts > 1 then 'MultiPolygon' else 'Polygon' end kind, cast(parts as int) parts, cast(5 * (parts + holes) as int) points, round(area, 6) area
from a join supplier on s_suppkey = key"""
)
def geojson_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communes with holes and exclaves, written and read back; a hole takes from the area."""
    path = store.shared_path(spark, "geojson")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    geojson.write_features(communes(spark, sf_dir).join(names, "key"), path)
    back = geojson.read_features(spark, path, "key: bigint, name: string")
    points = F.aggregate(F.flatten("geometry"), F.lit(0), lambda n, ring: n + F.size(ring))
    return back.select("key", "name", "kind", F.size("geometry").alias("parts"), points.alias("points"), R(G.area(F.col("geometry"))).alias("area"))


@query(f"with {CUBE}, t as (select distinct tile from cube) select tile, round((c_acctbal + 1000) / (1 + c_custkey % 4), 6) + 0 income from customer join t on tile = c_custkey")
def admin_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = store.attributes(admin(spark, sf_dir), cube(spark, sf_dir), "tile", ["Ind_snv"], "Ind")
    return got.select("tile", R(F.col("Ind_snv")).alias("income"))


@query(f"with {CUBE} select tile, service, round(sum(v), 6) + 0 as value from cube where time >= '21:30:00' or time <= '03:00:00' group by 1, 2")
def consumption_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubespark.operators.indices import consumption_in_window

    got = consumption_in_window(cube(spark, sf_dir), "21:30:00", "03:00:00", "tile", "service")
    return got.select("tile", "service", R(F.col("value")).alias("value"))


@query(
    """with t as (select distinct user_id tile from events), s as (select distinct event_type service from events),
sl as (select distinct extract(hour from ts) slot from events)
select tile, service, cast(slot as int) slot,
  cast(floor(100 * (('0x' || substr(md5('7:' || tile || ':' || service || ':' || slot), 1, 8))::bigint + 0.5) / 4294967296.0) as int) as value
from t cross join s cross join sl"""
)
def synthetic_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tiles, services, slots = e.select(F.col("user_id").alias("tile")).distinct(), e.select(F.col("event_type").alias("service")).distinct(), e.select(F.hour("ts").alias("slot")).distinct()
    return synthetic.cube(tiles, services, slots, seed="7").withColumn("value", F.col("value").cast("int"))


@query(
    """with d as (select cast(min(ts) as date) a, cast(max(ts) as date) b from events),
days as (select unnest(generate_series(a, b, interval 1 day)) d from d)
select strftime(d + to_minutes(15 * cast(m as bigint)), '%Y-%m-%d %H:%M:%S') moment, cast(m as int) slot from days cross join range(0, 96) t(m)"""
)
def datetime_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return synthetic.moments(ends, "a", "b", 15).select("moment", "slot")


@query("""select cast(extract(hour from ts) * 60 + extract(minute from ts) as int) "seconds", count(*) n from events group by 1""")
def log_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a progress log are made of the events' hours and minutes, and their marks are parsed again."""
    mark = F.format_string("100%%|####| %d/%d [%02d:%02d<00:00, 1.0s/it]", F.col("user_id"), F.col("user_id"), F.hour("ts"), F.minute("ts"))
    lines = table(spark, sf_dir, "events").select(mark.alias("line"))
    return store.log_durations(lines).groupBy("seconds").agg(F.count("*").alias("n"))


@query(f"with {CUBE} select service, count(*) n, round(sum(v), 6) + 0 as value from cube where service in ('click', 'view') group by 1")
def filter_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = C.filter_labels(cube(spark, sf_dir), "service", ["click", "view"], strict=True)
    return some.groupBy("service").agg(F.count("*").alias("n"), R(F.sum("value")).alias("value"))


def _bands_sql(ge: str, le: str) -> str:
    return f"""with {CUBE}, {INCOME}, act as (select tile, sum(v) a from cube group by 1), t as (select tile, a, li from act join inc using (tile) where li is not null),
q as (select quantile_cont(a, 0.6) a1, quantile_cont(a, 0.4) a0, quantile_cont(li, 0.6) l1, quantile_cont(li, 0.4) l0 from t)
select tile, case when a {ge} a1 and li {le} l0 then 'high_low' else 'low_high' end band from t, q
where (a {ge} a1 and li {le} l0) or (a {le} a0 and li {ge} l1)"""


def _bands(spark: SparkSession, sf_dir: str, inclusive: bool) -> DataFrame:
    c = cube(spark, sf_dir)
    activity = c.groupBy("tile").agg(F.sum("value").alias("activity"))
    rows = activity.join(incomes(spark, sf_dir, c), "tile").where("log2_income is not null")
    return C.quantile_bands(rows, ("activity", 0.6), ("log2_income", 0.4), inclusive).select("tile", "band")


@query(_bands_sql(">=", "<="))
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir, True)


@query(_bands_sql(">", "<"))
def quantile_bands_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir, False)


@query(f"""with {SALES} select "row", col, round(v, 6) + 0 as value from sales where "row" not in (1, 2, 3) and col not in ('Brand#1', 'Brand#2')""")
def drop_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.drop_labels(C.drop_labels(sales(spark, sf_dir), [1, 2, 3], "row"), ["Brand#1", "Brand#2"], "col")
    return s.select("row", "col", R(F.col("value")).alias("value"))


@query(f"with {CUBE}, {INCOME} select tile, round(li, 6) + 0 log2_income from inc where li is not null and tile % 7 <> 0")
def dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incomes with one more gap, every seventh tile, dropped."""
    i = incomes(spark, sf_dir, cube(spark, sf_dir)).withColumn("log2_income", F.when(F.col("tile") % 7 != 0, F.col("log2_income")))
    return i.na.drop(subset=["log2_income"]).select("tile", R(F.col("log2_income")).alias("log2_income"))


@query(f"with {CUBE} select 'city' axis, city as label from cube union select 'service', service from cube union select 'slot', cast(slot as varchar) from cube")
def cube_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labels_of(cube(spark, sf_dir), "city", "service", "slot")


@query(f"""with {CUBE}, m as (select r_name city, 'R' || r_regionkey new from region)
select new city, service, round(sum(v), 6) + 0 as value from cube join m using (city) group by 1, 2""")
def relabel_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    names = r.select(F.col("r_name").alias("label"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("new"))
    return C.relabel(cube(spark, sf_dir), "city", names).groupBy("city", "service").agg(R(F.sum("value")).alias("value"))


@query(f"""with {CUBE} select service, cast(case service when 'view' then 0 when 'click' then 1 else 2 end as int) pos, round(sum(v), 6) + 0 as value
from cube where service in ('view', 'click', 'purchase') group by 1, 2""")
def select_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.sum_over(cube(spark, sf_dir), "service")
    return C.select_ordered(sums, "service", ["view", "click", "purchase"]).select("service", "pos", R(F.col("value")).alias("value"))


@query(
    """with o as (select o_custkey key, count(*) orders from orders group by 1), e as (select user_id key, count(*) events from events group by 1)
select coalesce(o.key, e.key) key, orders, events from o full join e on o.key = e.key"""
)
def align_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("events"))
    return C.align("key", o, e)


@query(f"with {CUBE} select city, slot, round(sum(v), 6) + 0 as value from cube group by 1, 2")
def cube_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sum_over(cube(spark, sf_dir), "city", "slot").select("city", "slot", R(F.col("value")).alias("value"))


@query(
    f"""with {CUBE}, t as (select distinct city, tile from cube), k as (select distinct city, service, slot from cube)
select city, service, slot, round(avg(coalesce(v, 0)), 6) + 0 as value from k join t using (city) left join cube using (city, tile, service, slot) group by 1, 2, 3"""
)
def cube_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    mean = C.mean_over(c, "tile", "city", "service", "slot", members=c.select("city", "tile"))
    return mean.select("city", "service", "slot", R(F.col("value")).alias("value"))


@query("select cast(strftime(ts, '%H:%M') || ':00' as varchar) as time, round(sum(value), 6) + 0 as value from events group by 1")
def time_of_day_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "HH:mm:00").alias("time")).agg(R(F.sum("value")).alias("value"))


@query(
    """with t as (select c_acctbal a, cast(c_nationkey as double) b from customer)
select 'c_acctbal' as "column", round(avg(a), 6) mean, round(stddev_samp(a), 6) std, round(avg(a) + stddev_samp(a), 6) mean_plus_std from t
union all select 'c_nationkey', round(avg(b), 6), round(stddev_samp(b), 6), round(avg(b) + stddev_samp(b), 6) from t"""
)
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.column_stats(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey")
    return got.select("column", *[R(F.col(c)).alias(c) for c in ("mean", "std", "mean_plus_std")])


@query(
    f"""with {CUBE}, a as (select tile, sum(v) v from cube where service = 'click' group by 1), b as (select tile, sum(v) v from cube where service = 'view' group by 1)
select round(max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))), 6) max_abs_diff from a full join b using (tile)"""
)
def cube_max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (C.sum_over(cube(spark, sf_dir).where(F.col("service") == s), "tile") for s in ("click", "view"))
    return C.max_abs_difference(a, b, "tile").select(R(F.col("max_abs_diff")).alias("max_abs_diff"))


@query(f"with {CUBE}, s as (select service, sum(v) v from cube group by 1) select count(*) filter (where v > (select avg(v) from s)) split_point from s")
def split_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.sum_over(cube(spark, sf_dir), "service")
    mean = s.agg(F.avg("value").alias("m"))
    return s.crossJoin(F.broadcast(mean)).agg(F.count_if(F.col("value") > F.col("m")).alias("split_point"))


@query(
    f"""with {CUBE}, sl as (select distinct slot from cube), k as (select distinct service from cube),
g as (select service, slot, coalesce(sum(v), 0) v from k cross join sl left join cube using (service, slot) group by 1, 2),
p as (select service, slot, v / nullif((select sum(v) from g h where h.service = g.service), 0) p from g)
select service, slot, round((select sum(p) from p q where q.service = p.service and q.slot <= p.slot), 6) + 0 cdf from p"""
)
def cdf_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    grid = C.dense(C.sum_over(c, "service", "slot"), c, "service")
    return C.cumulative(C.share(grid, "service"), "service").select("service", "slot", R(F.col("cdf")).alias("cdf"))


@query(f"with {CUBE}, s as (select tile, service, sum(v) v from cube group by 1, 2), t as (select tile, sum(v) t from s group by 1) select tile, service, round(v / nullif(t, 0), 6) + 0 share from s join t using (tile)")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.share(C.sum_over(cube(spark, sf_dir), "tile", "service"), "tile").select("tile", "service", R(F.col("share")).alias("share"))


@query(
    """select o_custkey key, arg_min(o_orderkey, (cast(o_orderpriority as varchar), o_orderkey)) o_orderkey, min(o_orderpriority) o_orderpriority
from orders group by 1"""
)
def first_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderpriority")
    return C.first_by(o, "key", ["o_orderpriority", "o_orderkey"])


RANK = "r as (select service, sum(v) v, row_number() over (order by sum(v) desc, service) rank from cube group by 1)"


@query(f"with {CUBE}, {RANK} select service, cast(rank as int) rank, round(v, 6) + 0 as value from r")
def service_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(C.sum_over(cube(spark, sf_dir), "service"), "service").select("service", "rank", R(F.col("value")).alias("value"))


@query(
    f"""with {CUBE}, {RANK} select 'top' side, cast(rank as int) place, service, round(v, 6) + 0 as value from r where rank <= 2
union all select 'bottom', cast((select count(*) from r) - rank + 1 as int), service, round(v, 6) + 0 from r where rank > (select count(*) from r) - 2"""
)
def top_bottom_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.top_and_bottom(C.sum_over(cube(spark, sf_dir), "service"), "service", 2)
    return got.select("side", "place", "service", R(F.col("value")).alias("value"))


@query(
    f"""with {CUBE}, t as (select distinct time from cube)
select time, cast(row_number() over (order by case when time < '21:00:00' then 1 else 0 end, time) - 1 as int) slot from t"""
)
def cyclic_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter hours in order from 21:00."""
    return C.cyclic_slots(cube(spark, sf_dir), "21:00:00")


@query(f"with {CUBE} select city, service, count(*) n, round(sum(v), 6) + 0 as value from cube group by 1, 2")
def concat_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube that is split by service and put together again."""
    c = cube(spark, sf_dir)
    whole = C.concat_cubes(*[c.where(F.col("service") == s) for s in SERVICES], same_slots=False)
    return whole.groupBy("city", "service").agg(F.count("*").alias("n"), R(F.sum("value")).alias("value"))


@query(
    f"""with {CUBE}, s as (select city, {', '.join(f"round(sum(case when service = '{s}' then v end), 6) as {s}" for s in SERVICES)} from cube group by 1)
{' union all '.join(f"select city, '{s}' service, {s} as value from s" for s in SERVICES)}"""
)
def unpivot_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = cube(spark, sf_dir).groupBy("city", "service").agg(R(F.sum("value")).alias("value"))
    wide = C.pivot(sums, "city", "service", list(SERVICES), "value")
    return C.unpivot(wide, ["city"], list(SERVICES), "service", "value")


@query(
    """select o_orderkey, round(log2(o_totalprice), 6) l2, round(log2(1 + o_totalprice), 6) l2p, round(log10(1 + o_totalprice), 6) l10p, round(ln(1 + o_totalprice), 6) lnp,
round(sqrt(o_totalprice), 6) root, greatest(o_totalprice, 150000.0) clamped, case when o_totalprice > 150000 then 1 else 0 end bin,
case when o_totalprice <= 100000 then 'low' when o_totalprice <= 200000 then 'medium' else 'high' end class,
regexp_replace(o_orderpriority, '^.*-', '') suffix, strftime(timestamp '2000-01-01' + to_seconds((o_orderkey * 977) % 86400), '%H:%M:%S') clock,
cast((o_orderkey * 977 % 86400 - 79200 + 86400) % 86400 as int) after_ten,
round((('0x' || substr(md5('3:' || o_orderkey), 1, 8))::bigint + 0.5) / 4294967296.0, 6) draw from orders"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("o_totalprice"), F.col("o_orderkey") * 977 % 86400
    clock = S.clock_of(s)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", R(S.log2(p)).alias("l2"), R(S.log2_plus_one(p)).alias("l2p"), R(S.log10_plus_one(p)).alias("l10p"), R(S.ln_plus_one(p)).alias("lnp"),
        R(F.sqrt(p)).alias("root"), F.greatest(p, F.lit(150000.0)).alias("clamped"), S.binarise(p, 150000).alias("bin"),
        S.interval_class(p, [F.lit(100000), F.lit(200000)], ["low", "medium", "high"]).alias("class"), S.suffix(F.col("o_orderpriority"), "-").alias("suffix"),
        clock.alias("clock"), S.cyclic_seconds(S.seconds_of(clock), "22:00:00").alias("after_ten"), R(S.uniform("3", F.col("o_orderkey"))).alias("draw"),
    )


_ISO = "ln(tan(pi() / 4 + radians(lat) / 2)) - 0.0818191910428158 / 2 * ln((1 + 0.0818191910428158 * sin(radians(lat))) / (1 - 0.0818191910428158 * sin(radians(lat))))"


@query(
    f"""with p as (select c_custkey key, -4 + (c_custkey % 120) / 10.0 lon, 42 + (c_custkey * 7 % 90) / 10.0 lat from customer),
q as (select key, 11754255.426096 * exp(-0.7256077650532670 * ({_ISO})) r, 0.7256077650532670 * (radians(lon) - radians(3)) t from p)
select key, round(700000.0 + r * sin(t), 3) x, round(12655612.049876 - r * cos(t), 3) y from q"""
)
def lambert93(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = S.lambert93(-4 + (k % 120) / 10.0, 42 + (k * 7 % 90) / 10.0)
    return table(spark, sf_dir, "customer").select(k.alias("key"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    f"""with {CUBE}, {INCOME}, n as (select service, count(*) rows_, count(distinct tile) tiles from cube group by 1)
select service, rows_ as n_rows, tiles as n_tiles from n"""
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).groupBy("service").agg(F.count("*").alias("n_rows"), F.countDistinct("tile").alias("n_tiles"))


@query(f"with {CUBE}, {INCOME} select tile, round(li, 6) + 0 log2_income from inc")
def log2_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.log2_income(admin(spark, sf_dir)).join(cube(spark, sf_dir).select("tile").distinct(), "tile")
    return got.select("tile", R(F.col("log2_income")).alias("log2_income"))
