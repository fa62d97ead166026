"""Night index, advantage, service space, income classes, sessions, commuting and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions.scalars import rounded
from cubespark.operators import cube as C
from cubespark.operators import indices as X
from cubespark.operators import mobility as M
from cubespark.operators.income import cube_by_class, income_classes
from cubespark.queries.base import (
    CLASS, CLASSES, CUBE, INCOME, NSI, QS, SALES, TILES, admin, cube, incomes, query, sales, stored_cube, table, tile_boxes,
)
from cubespark.sources.store import cut_lineage

R = rounded


@query(f"with {CUBE}, {NSI} select city, tile, round(nsi, 6) + 0 night_index from nsi")
def nsi_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = X.night_index(cube(spark, sf_dir), "tile")
    return got.select("city", "tile", R(F.col("night_index")).alias("night_index"))


@query(f"with {CUBE}, {NSI} select city, tile, round(nsi, 6) + 0 night_index from nsi")
def nsi_cdf_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = X.night_index_by_cdf(cube(spark, sf_dir), "tile")
    return got.select("city", "tile", R(F.col("night_index")).alias("night_index"))


NSI_SERVICE = NSI.replace("tile", "service")


@query(f"with {CUBE}, {NSI_SERVICE} select city, service, round(nsi, 6) + 0 night_index from nsi")
def nsi_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.night_index(cube(spark, sf_dir), "service").select("city", "service", R(F.col("night_index")).alias("night_index"))


@query(
    f"""with {CUBE}, {NSI_SERVICE} select service, {', '.join(f"round(max(case when city = '{c}' then nsi end), 6) + 0 {c.lower().replace(' ', '_')}" for c in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))} from nsi group by 1"""
)
def nsi_service_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = C.pivot(X.night_index(cube(spark, sf_dir), "service"), "service", "city", cities, "night_index")
    return wide.select("service", *[R(F.col(c)).alias(c.lower().replace(" ", "_")) for c in cities])


@query(f"with {CUBE}, {NSI}, {INCOME} select city, tile, round(nsi, 6) + 0 night_index, round(li, 6) + 0 log2_income from nsi join inc using (tile)")
def nsi_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    got = X.night_index(c, "tile").join(incomes(spark, sf_dir, c), "tile")
    return got.select("city", "tile", R(F.col("night_index")).alias("night_index"), R(F.col("log2_income")).alias("log2_income"))


@query(f"with {CUBE}, {NSI}, {CLASS}, {TILES} select city, tile, c income_class, round(nsi, 6) + 0 night_index, x0 xmin, y0 ymin from nsi join cls using (tile) join tile_geo on key = tile")
def nsi_income_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    classes = income_classes(incomes(spark, sf_dir, c), QS).where("income_class is not null")
    got = X.night_index(c, "tile").join(classes, "tile").join(tile_boxes(spark, sf_dir).withColumnRenamed("key", "tile"), "tile")
    return got.select("city", "tile", "income_class", R(F.col("night_index")).alias("night_index"), "xmin", "ymin")


@query(f"with {CUBE}, {CLASS} select tile, c income_class from inc left join cls using (tile)")
def income_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return income_classes(incomes(spark, sf_dir, stored_cube(spark, sf_dir)), QS).select("tile", "income_class")


#: Mean over the tiles of a pooled class, absent rows counting as zero.
BY_CLASS = """tn as (select c, count(*) n from cls group by 1),
bc as (select c, service, slot, sum(v) / any_value(n) v from cube join cls using (tile) join tn using (c) group by 1, 2, 3)"""


def by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    return cube_by_class(c, income_classes(incomes(spark, sf_dir, c), QS))


@query(f"with {CUBE}, {CLASS}, {BY_CLASS} select c income_class, service, slot, round(v, 6) + 0 as value from bc")
def cube_by_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_class(spark, sf_dir).select("income_class", "service", "slot", R(F.col("value")).alias("value"))


@query(
    f"""with {CUBE}, {INCOME}, t as (select distinct city, tile from cube), ci as (select city, tile, li from t join inc using (tile)),
cut as (select city, quantile_cont(li, 0.3) a, quantile_cont(li, 0.7) b from ci group by 1),
cls as (select city, tile, case when li <= a then 'q0' when li <= b then 'q1' else 'q2' end c from ci join cut using (city) where li is not null),
tn as (select city, c, count(*) n from cls group by 1, 2)
select city, c income_class, service, slot, round(sum(v) / any_value(n), 6) + 0 as value from cube join cls using (city, tile) join tn using (city, c) group by 1, 2, 3, 4"""
)
def cube_by_income_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    tiles = c.select("city", "tile").distinct()
    classes = income_classes(tiles.join(incomes(spark, sf_dir, c), "tile"), QS, ("city",))
    return cube_by_class(c, classes, ("city",)).select("city", "income_class", "service", "slot", R(F.col("value")).alias("value"))


def _rca_sql(cells: str, row: str, col: str, out: str) -> str:
    """The advantage of cells (row, col, v) by joins with the three totals."""
    return f"""m as ({cells}), rt as (select {row}, sum(v) r from m group by 1), ct as (select {col}, sum(v) c from m group by 1), gt as (select sum(v) g from m),
rca as (select m.{row}, m.{col}, m.v, (m.v / nullif(ct.c, 0)) / nullif(rt.r / nullif(gt.g, 0), 0) rca from m join rt using ({row}) join ct using ({col}), gt) {out}"""


SALES_RCA = _rca_sql('select "row", col, v from sales', '"row"', "col", "")


@query(f"""with {SALES}, {SALES_RCA} select "row", col, round(rca, 6) + 0 rca from rca""")
def rca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.comparative_advantage(sales(spark, sf_dir), "row", "col").select("row", "col", R(F.col("rca")).alias("rca"))


@query(
    f"""with {SALES} select "row", col, 0 as level, round(v, 6) total from sales union all select "row", null, 1, round(sum(v), 6) from sales group by 1
union all select null, col, 2, round(sum(v), 6) from sales group by col union all select null, null, 3, round(sum(v), 6) from sales"""
)
def rca_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = X.margins(sales(spark, sf_dir), "row", "col")
    return got.select("row", "col", F.col("level").cast("int").alias("level"), R(F.col("total")).alias("total"))


@query(f"""with {CUBE}, {CLASS}, {BY_CLASS}, {_rca_sql('select c k, service, sum(v) v from bc group by 1, 2', 'k', 'service', '')} select k income_class, service, round(rca, 6) + 0 rca from rca""")
def rca_income_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.sum_over(by_class(spark, sf_dir), "income_class", "service")
    return X.comparative_advantage(sums, "income_class", "service").select("income_class", "service", R(F.col("rca")).alias("rca"))


@query(f"""with {CUBE}, {CLASS}, {_rca_sql('select c k, service, sum(v) v from cube join cls using (tile) group by 1, 2', 'k', 'service', '')} select k income_class, service, round(rca, 6) + 0 rca from rca""")
def rca_income_service_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On sums; classes without tiles stay as zeros."""
    c = stored_cube(spark, sf_dir)
    classes = income_classes(incomes(spark, sf_dir, c), QS).where("income_class is not null")
    sums = c.join(classes, "tile").groupBy("income_class", "service").agg(F.sum("value").alias("value"))
    labels = spark.createDataFrame([(k,) for k in CLASSES], "income_class string").crossJoin(F.broadcast(c.select("service").distinct()))
    every = labels.join(sums, ["income_class", "service"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return X.comparative_advantage(every, "income_class", "service").select("income_class", "service", R(F.col("rca")).alias("rca"))


@query(f"""with {CUBE}, {CLASS}, {BY_CLASS}, {_rca_sql('select c k, slot, sum(v) v from bc group by 1, 2', 'k', 'slot', '')} select k income_class, slot, round(rca, 6) + 0 rca from rca""")
def rca_income_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.sum_over(by_class(spark, sf_dir), "income_class", "slot")
    return X.comparative_advantage(sums, "income_class", "slot").select("income_class", "slot", R(F.col("rca")).alias("rca"))


TILE_RCA = _rca_sql("select tile, service, sum(v) v from cube group by 1, 2", "tile", "service", "")


@query(f"with {CUBE}, {TILE_RCA} select tile, service, round(rca, 6) + 0 rca from rca")
def rca_tile_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.sum_over(cube(spark, sf_dir), "tile", "service")
    return X.comparative_advantage(sums, "tile", "service").select("tile", "service", R(F.col("rca")).alias("rca"))


@query(f"with {CUBE}, {TILES}, {TILE_RCA} select tile, service, round(rca, 6) + 0 rca, x0 xmin, y0 ymin from rca join tile_geo on key = tile")
def rca_tile_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.sum_over(cube(spark, sf_dir), "tile", "service")
    got = X.comparative_advantage(sums, "tile", "service").join(tile_boxes(spark, sf_dir).withColumnRenamed("key", "tile"), "tile")
    return got.select("tile", "service", R(F.col("rca")).alias("rca"), "xmin", "ymin")


#: Proximity by a dense cross join of labels and rows.
SPACE = f"""{SALES}, {SALES_RCA}, has as (select "row", col, coalesce(rca > 1, false) h from rca), lab as (select distinct col from rca), rows_ as (select distinct "row" from rca),
dn as (select "row", col, coalesce(h, false) h from rows_ cross join lab left join has using ("row", col)),
space as (select x.col a, y.col b, sum(case when x.h and y.h then 1 else 0 end) / nullif(greatest(sum(x.h::int), sum(y.h::int)), 0) proximity
  from dn x join dn y using ("row") group by 1, 2)"""


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.service_space(X.comparative_advantage(sales(spark, sf_dir), "row", "col"), "row", "col")


@query(f"with {SPACE} select a, b, round(proximity, 6) + 0 proximity from space")
def service_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space(spark, sf_dir).select("a", "b", R(F.col("proximity")).alias("proximity"))


@query(f"with {CUBE} select service, round(log10(1 + sum(v)), 6) log10_consumption from cube group by 1")
def log10_service_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.log10_consumption(cube(spark, sf_dir)).select("service", R(F.col("log10_consumption")).alias("log10_consumption"))


@query(
    f"""with {CUBE}, {CLASS}, {BY_CLASS}, {_rca_sql('select c k, service, sum(v) v from bc group by 1, 2', 'k', 'service', '')}
select service, coalesce(max(case when rca > 1 then k end), 'none') category from rca group by 1"""
)
def dominant_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.sum_over(by_class(spark, sf_dir), "income_class", "service")
    return X.dominant_category(X.comparative_advantage(sums, "income_class", "service"), "service", "income_class", list(CLASSES), "none")


# -- sessions: location = event type, slot = hour, p = share within (location, day) ------------------------------------


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    counts = e.groupBy(F.col("event_type").alias("location"), F.to_date("ts").alias("day"), F.hour("ts").alias("slot")).agg(F.count("*").cast("double").alias("value"))
    return C.share(counts, "location", "day", name="p").drop("value")


SESSION = """ses as (select event_type loc, cast(ts as date) d, extract(hour from ts) slot, count(*) / sum(count(*)) over (partition by event_type, cast(ts as date)) p
  from events group by 1, 2, 3),
dd as (select distinct loc, d from ses), sp as (select loc, slot, sum(p) / (select count(*) from dd where dd.loc = ses.loc) p from ses group by loc, slot)"""


@query(f"with {SESSION} select loc location, cast(slot as int) slot, round(p, 6) p from sp")
def session_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.session_probability(sessions(spark, sf_dir)).select("location", "slot", R(F.col("p")).alias("p"))


@query(
    f"""with {SESSION}, e as (select loc, sum(p * slot) e from sp group by 1)
select loc location, round(e, 6) expected_slot, strftime(timestamp '2000-01-01' + to_minutes(cast(round_even(e * 60, 0) as bigint)), '%H:%M:%S') expected_clock from e"""
)
def session_expected_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.expected_time(X.session_probability(sessions(spark, sf_dir)), "location", 60, "00:00:00")
    return e.select("location", R(F.col("expected_slot")).alias("expected_slot"), "expected_clock")


@query(
    f"""with {SESSION}, g as (select a.loc, b.slot, coalesce(sp.p, 0) p from (select distinct loc from sp) a cross join (select distinct slot from sp) b left join sp on sp.loc = a.loc and sp.slot = b.slot),
f as (select loc, slot, (select sum(p) from g h where h.loc = g.loc and h.slot <= g.slot) f from g), m as (select slot, avg(f) m from f group by 1)
select loc location, round(sum(f - m), 6) + 0 deviation from f join m using (slot) group by 1"""
)
def session_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cut_lineage(X.session_probability(sessions(spark, sf_dir)))  # for its rows, its locations and its slots
    grid = C.dense(p, p, "location", value="p")
    return X.deviation_from_mean_cdf(grid, "location").select("location", R(F.col("deviation")).alias("deviation"))


# -- commuting and votes -----------------------------------------------------------------------------------------------


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return j.groupBy(F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("work")).agg(F.count("*").alias("count"))


def commute(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    h, w = F.col("home"), F.col("work")
    pairs = n.select(F.col("k").alias("home")).crossJoin(F.broadcast(n.select(F.col("k").alias("work")))).where(h != w)  # 25 nations
    trips = pairs.select("home", "work", (300 + 60 * ((h * 7 + w * 13) % 50)).alias("duration_seconds"), (1000 + 500 * ((h * 11 + w * 5) % 40)).alias("distance_meters"))
    modes = n.select(F.col("k").alias("home"), (((F.col("k") * 17) % 80 + 10) / 100).alias("car_share"))
    return M.commute_duration(_flows(spark, sf_dir), trips, modes, 0.03)


COMMUTE = """fl as (select c_nationkey h, s_nationkey w, count(*) n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey group by 1, 2), tot as (select h, sum(n) t from fl group by 1),
com as (select h, sum(n * (1 - car) * s + n * car * (m / 30000.0 * 3600)) / any_value(t) secs from (
  select fl.*, t, ((h * 17) % 80 + 10) / 100.0 car, case when h = w then 300 else 300 + 60 * ((h * 7 + w * 13) % 50) end s,
    case when h = w then 1000 else 1000 + 500 * ((h * 11 + w * 5) % 40) end m from fl join tot using (h) where n / t > 0.03) group by 1)"""


@query(f"with {COMMUTE} select h home, round(secs, 6) mean_seconds from com")
def commute_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commute(spark, sf_dir).select("home", R(F.col("mean_seconds")).alias("mean_seconds"))


@query(
    f"""with {COMMUTE}, {CUBE}, {NSI}, {INCOME}
select tile, round(nsi, 6) + 0 night_index, round(secs / 60, 6) duration_minutes, round(log2(secs / 60), 6) log2_minutes, round(li, 6) log2_income
from nsi join inc using (tile) join customer on c_custkey = tile join com on h = c_nationkey where secs < 50 * 60 and li is not null"""
)
def commute_nsi_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored_cube(spark, sf_dir)
    home = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tile"), F.col("c_nationkey").alias("home"))
    got = X.night_index(c, "tile").join(incomes(spark, sf_dir, c), "tile").join(home, "tile").join(commute(spark, sf_dir), "home")
    got = got.where("mean_seconds < 50 * 60 and log2_income is not null").withColumn("minutes", F.col("mean_seconds") / 60)
    return got.select("tile", R(F.col("night_index")).alias("night_index"), R(F.col("minutes")).alias("duration_minutes"), R(F.log2("minutes")).alias("log2_minutes"), R(F.col("log2_income")).alias("log2_income"))


PARTIES = ["1-URGENT", "5-LOW"]


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("party")).agg(F.count("*").cast("double").alias("value"))
    return C.share(counts, "unit", name="pct").withColumn("radius", (F.col("unit") * 37 % 2000).cast("double"))


VOTE = """vote as (select o_custkey unit, sum(case when o_orderpriority in ('1-URGENT', '5-LOW') then 1 end) / count(*) pct from orders where (o_custkey * 37) % 2000 < 1200 group by 1)"""


@query(f"with {VOTE} select unit, round(pct, 6) vote_share from vote where pct is not null")
def vote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.vote_share(votes(spark, sf_dir), PARTIES).select("unit", R(F.col("vote_share")).alias("vote_share"))


SOCIAL = """soc as (select user_id unit, sum(case when event_type in ('click', 'view') then value else 0 end) / nullif(sum(value), 0) share from events group by 1)"""


@query(f"with {SOCIAL} select unit, round(share, 6) social_share from soc")
def social_media_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("service"), "value")
    return X.social_share(c, "unit", ["click", "view"]).select("unit", R(F.col("social_share")).alias("social_share"))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit with everything: share, vote, income and control counts; rows with a gap are dropped."""
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("service"), "value")
    share = X.social_share(c, "unit", ["click", "view"])
    vote = M.vote_share(votes(spark, sf_dir), PARTIES)
    income = admin(spark, sf_dir).select(F.col("tile").alias("unit"), F.col("Ind_snv").alias("income"), F.col("Ind").alias("persons"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit"))
    counts = o.agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.avg("o_totalprice").alias("mean_price"))
    return C.align("unit", share, vote, income, counts).na.drop()


@query(
    f"""with {SOCIAL}, {VOTE}, o as (select o_custkey unit, count(*) orders, count(*) filter (where o_orderstatus = 'F') finished, avg(o_totalprice) mean_price from orders group by 1)
select unit, round(share, 6) social_share, round(pct, 6) vote_share, round(c_acctbal + 1000, 6) income, cast(1 + c_custkey % 4 as double) persons, orders, finished, round(mean_price, 6) mean_price
from soc join vote using (unit) join customer on c_custkey = unit join o using (unit) where pct is not null and share is not null"""
)
def vote_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = controls(spark, sf_dir)
    return got.select("unit", *[R(F.col(c)).alias(c) for c in ("social_share", "vote_share", "income")], "persons", "orders", "finished", R(F.col("mean_price")).alias("mean_price"))


@query(
    f"""with {SOCIAL}, {VOTE}, {TILES} select unit, round(share, 6) social_share, round(pct, 6) vote_share, round(c_acctbal + 1000, 6) income, c_mktsegment education, x0 xmin, y0 ymin
from soc join vote using (unit) join customer on c_custkey = unit join tile_geo on key = unit where pct is not null and share is not null"""
)
def vote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four map columns of each unit with its place."""
    education = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("education"))
    got = controls(spark, sf_dir).join(education, "unit").join(tile_boxes(spark, sf_dir).withColumnRenamed("key", "unit"), "unit")
    return got.select("unit", *[R(F.col(c)).alias(c) for c in ("social_share", "vote_share", "income")], "education", "xmin", "ymin")
