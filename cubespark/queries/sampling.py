"""Monte-Carlo screen time, robustness samples and time profiles. Draws are keyed, so SQL makes the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions import scalars as S
from cubespark.operators import cube as C
from cubespark.operators import indices as X
from cubespark.operators import sampling as M
from cubespark.operators.income import cube_by_class, income_classes
from cubespark.operators.stats import density
from cubespark.queries.base import AMENITY, CLASS, CUBE, NSI, QS, SERVICES, TILES, cube, incomes, query, stored_cube, table
from cubespark.queries.spatial import SAMPLES, samples
from cubespark.sources.store import cut_lineage

R = S.rounded
N_SAMPLES = 15
#: Services of the events stand for five of the rate table's.
STANDS_FOR = {"click": "TWITTER", "error": "WIKIPEDIA", "purchase": "WEB_FOOD", "signup": "WEB_FINANCE", "view": "WEB_GAMES"}


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, float(M.MB_PER_HOUR[STANDS_FOR[s]])) for s in SERVICES], "service string, mb_per_hour double")


RATE = "rate(service, mb) as (values " + ", ".join(f"('{s}', {M.MB_PER_HOUR[STANDS_FOR[s]]}.0)" for s in SERVICES) + ")"


def _u(key: str, word: int) -> str:
    return f"((('0x' || substr(md5({key}), {1 + 8 * word}, 8))::bigint + 0.5) / 4294967296.0)"


def _normal(mean: str, key: str) -> str:
    return f"greatest({mean} + 0.5 * {mean} * sqrt(-2 * ln({_u(key, 0)})) * cos(2 * pi() * {_u(key, 1)}), 0.001)"


#: Minutes by counting, for each traffic value, the cumulative draws below it, as the definition says.
MINUTES = f"""{RATE}, smp(sample) as (select unnest(range(0, {N_SAMPLES}))),
mx as (select city, service, max(v) m, any_value(mb) mb from cube join rate using (service) group by 1, 2),
tk as (select sample, city, service, i, {_normal('mb / 60', "'0:' || sample || ':' || city || ':' || service || ':' || i")} d
  from mx cross join smp cross join lateral (select unnest(range(1, cast(ceil(1.5 * m / (mb / 60)) as bigint) + 65)) i)),
cum as (select sample, city, service, sum(d) over (partition by sample, city, service order by i) c from tk),
lst as (select sample, city, service, list(c order by c) cs from cum group by 1, 2, 3),
st as materialized (select sample, city, tile, service, slot, cast(len(list_filter(cs, lambda x: x < cube.v)) as double) v from cube join lst using (city, service))"""


#: Minutes from one draw of the rate per sample and service.
MEAN_MINUTES = f"""mr as (select sample, service, {_normal('mb / 60', "'0:' || sample || ':' || service")} mr from rate cross join smp),
mst as materialized (select sample, city, tile, service, slot, v / mr v from cube join mr using (service))"""


def individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.screen_time_samples(stored_cube(spark, sf_dir), rates(spark), N_SAMPLES, "individual")


@query(f"with {CUBE}, {MINUTES} select cast(sample as int) as sample, city, tile, service, slot, v as minutes_ from st")
def screen_time_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return individual(spark, sf_dir).select("sample", "city", "tile", "service", "slot", F.col("value").alias("minutes_"))


@query(
    f"""with {CUBE}, {RATE}, smp(sample) as (select unnest(range(0, {N_SAMPLES}))), {MEAN_MINUTES}
select cast(sample as int) as sample, city, service, round(sum(v), 6) + 0 as value from mst group by 1, 2, 3"""
)
def screen_time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.screen_time_samples(cube(spark, sf_dir), rates(spark), N_SAMPLES, "mean")
    return got.groupBy("sample", "city", "service").agg(R(F.sum("value")).alias("value"))


def nsi_over(source: str, scope: str) -> str:
    """The index per (scope, city, tile) of a table of samples, by cumulative distributions."""
    return f"""sl as (select * from (select distinct {scope} from {source}) cross join (select distinct slot from cube)), tl as (select distinct {scope}, city, tile from {source}),
sm as (select {scope}, city, tile, slot, sum(v) v from {source} group by all),
grid as (select {scope}, city, tile, slot, coalesce(v, 0) v from tl join sl using ({scope}) left join sm using ({scope}, city, tile, slot)),
pr as (select *, v / nullif(sum(v) over (partition by {scope}, city, tile), 0) p from grid),
cdf as (select *, sum(p) over (partition by {scope}, city, tile order by slot) f from pr),
mf as (select {scope}, city, slot, avg(f) m from cdf group by all),
nsi as (select {scope}, city, tile, coalesce(sum(m - f), 0) nsi from cdf join mf using ({scope}, city, slot) group by all)"""


@query(f"with {CUBE}, {MINUTES}, {nsi_over('st', 'sample')} select cast(sample as int) as sample, city, tile, round(nsi, 6) + 0 night_index from nsi")
def nsi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = X.night_index(individual(spark, sf_dir), "tile", ("sample", "city"))
    return got.select("sample", "city", "tile", R(F.col("night_index")).alias("night_index"))


@query(
    f"""with {CUBE}, {MINUTES}, {nsi_over('st', 'sample')}, {CLASS}, per as (select sample, c, avg(nsi) a from nsi join cls using (tile) group by 1, 2)
select c income_class, round(avg(a), 6) + 0 mean, round(stddev_samp(a), 6) + 0 std from per group by 1"""
)
def nsi_income_robust_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes over the union of all samples' tiles; mean and deviation over samples of the class means."""
    index = cut_lineage(X.night_index(individual(spark, sf_dir), "tile", ("sample", "city")))
    classes = income_classes(cut_lineage(incomes(spark, sf_dir, index)), QS).where("income_class is not null")
    per = index.join(classes, "tile").groupBy("sample", "income_class").agg(F.avg("night_index").alias("a"))
    return per.groupBy("income_class").agg(R(F.avg("a")).alias("mean"), R(F.stddev_samp("a")).alias("std"))


def _classes_sql(source: str, scope: str) -> str:
    """Income classes recomputed over the tiles of each sample."""
    return f"""si as (select distinct {scope}, tile, case when c_acctbal + 1000 > 0 then log2((c_acctbal + 1000) / (1 + c_custkey % 4)) end li from {source} join customer on c_custkey = tile),
sq as (select {scope}, quantile_cont(li, 0.3) a, quantile_cont(li, 0.7) b from si group by all),
cls as (select {scope}, tile, case when li <= a then 'q0' when li <= b then 'q1' else 'q2' end c from si join sq using ({scope}) where li is not null)"""


@query(
    f"""with {CUBE}, {TILES}, {AMENITY}, {SAMPLES}, {nsi_over('samples', 'threshold, buffer_m')}, {CLASS}
select threshold, buffer_m, c income_class, round(avg(nsi), 6) + 0 night_index from nsi join cls using (tile) group by 1, 2, 3"""
)
def nsi_income_robust_amenity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = X.night_index(samples(spark, sf_dir), "tile", ("threshold", "buffer_m", "city"))
    classes = income_classes(incomes(spark, sf_dir, stored_cube(spark, sf_dir)), QS).where("income_class is not null")
    got = index.join(classes, "tile").groupBy("threshold", "buffer_m", "income_class").agg(F.avg("night_index").alias("a"))
    return got.select("threshold", "buffer_m", "income_class", R(F.col("a")).alias("night_index"))


def rca_samples_sql(source: str, scope: str) -> str:
    return f"""{_classes_sql(source, scope)}, tn as (select {scope}, c, count(*) n from cls group by all),
m as (select {scope}, c, service, sum(v) / any_value(n) v from {source} join cls using ({scope}, tile) join tn using ({scope}, c) group by all),
rt as (select {scope}, c, sum(v) r from m group by all), ct as (select {scope}, service, sum(v) k from m group by all), gt as (select {scope}, sum(v) g from m group by all),
rca as (select {scope}, c income_class, service, round((v / nullif(k, 0)) / nullif(r / nullif(g, 0), 0), 6) + 0 rca
  from m join rt using ({scope}, c) join ct using ({scope}, service) join gt using ({scope}))"""


def _rca_samples(spark: SparkSession, sf_dir: str, rows: DataFrame, *scope: str) -> DataFrame:
    rows = cut_lineage(rows)  # for the tiles, their classes and the sums
    tiles = rows.select(*scope, "tile").distinct()
    classes = income_classes(cut_lineage(tiles.join(incomes(spark, sf_dir, rows), "tile")), QS, scope)  # read in each pass of the quantiles
    sums = C.sum_over(cube_by_class(rows, classes, scope), *scope, "income_class", "service")
    got = X.comparative_advantage(sums, "income_class", "service", within=scope)
    return got.select(*scope, "income_class", "service", R(F.col("rca")).alias("rca"))


@query(f"with {CUBE}, {MINUTES}, {rca_samples_sql('st', 'sample')} select cast(sample as int) as sample, income_class, service, rca from rca")
def rca_samples_screen_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rca_samples(spark, sf_dir, individual(spark, sf_dir), "sample")


@query(f"with {CUBE}, {TILES}, {AMENITY}, {SAMPLES}, {rca_samples_sql('samples', 'threshold, buffer_m')} select * from rca")
def rca_samples_amenity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rca_samples(spark, sf_dir, samples(spark, sf_dir), "threshold", "buffer_m")


# -- time profiles -----------------------------------------------------------------------------------------------------

N_DRAWS = 1000


def _profile_sql(by: str, source: str) -> str:
    key = by.replace(", ", " || ':' || ")
    return f"""g as (select {key} k, slot, sum(v) v from {source} group by all), pr as (select k, slot, v / nullif(sum(v) over (partition by k), 0) p from g),
cm as (select k, slot, sum(p) over (partition by k order by slot) f from pr), dr as (select k, i, {_u("'0:' || k || ':' || i", 0)} u from (select distinct k from g) cross join range(1, {N_DRAWS + 1}) t(i)),
sp as (select dr.k, i, coalesce(min(slot) filter (where f >= u), max(slot)) slot from dr join cm using (k) group by dr.k, i, u)"""


PROFILE_OUT = "cast(count(*) as bigint) n, round(avg(slot), 6) mean, round(quantile_cont(slot::double, 0.25), 6) q25, round(quantile_cont(slot::double, 0.5), 6) median, round(quantile_cont(slot::double, 0.75), 6) q75"


def _drawn(sums: DataFrame) -> DataFrame:
    """sums: (k, slot, value)."""
    p = C.share(sums, "k", name="p").select("k", "slot", "p")
    return M.sample_times(p, "k", N_DRAWS)


def _summary(draws: DataFrame) -> DataFrame:
    q = F.percentile("slot", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = draws.groupBy("k").agg(F.count("*").alias("n"), R(F.avg("slot")).alias("mean"), q.alias("q"))
    return got.select("k", "n", "mean", *[R(F.col("q")[i]).alias(c) for i, c in enumerate(("q25", "median", "q75"))])


@query(f"with {CUBE}, {_profile_sql('service', 'cube')} select k, i, slot from sp")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = cube(spark, sf_dir).groupBy(F.col("service").alias("k"), "slot").agg(F.sum("value").alias("value"))
    return _drawn(sums).withColumn("i", F.col("i").cast("long"))


# Of sums up to each slot: the first heavy slot past where a light one's lack begins; the light one that takes a heavy one past its excess.
@query(
    f"""with {CUBE}, g as (select service k, slot, sum(v) v from cube group by all having sum(v) > 0), w as (select k, slot, v / avg(v) over (partition by k) w from g),
s as materialized (select k, slot, w, w > 1 heavy, sum(abs(w - 1)) over (partition by k, w > 1 order by slot) s, count(*) over (partition by k) n, row_number() over (partition by k order by slot) - 1 pos from w),
nxt as (select k, slot, lead(slot) over (partition by k order by slot) after from s where heavy),
t as materialized (select k, slot, n, pos, case when not heavy then w when after is null then 1 else coalesce(1 - ((select min(b.s) from s b where b.k = s.k and not b.heavy and b.s >= s.s) - s.s), 1) end keep,
  case when heavy then coalesce(after, slot) else coalesce((select min(b.slot) from s b where b.k = s.k and b.heavy and b.s > s.s - abs(s.w - 1)), slot) end other from s left join nxt using (k, slot)),
d as (select k, i, least(floor({_u("'0:' || k || ':' || i", 0)} * n), n - 1) pos, {_u("'0:' || k || ':' || i", 1)} u from (select distinct k, n from t) cross join range(1, {N_DRAWS + 1}) r(i))
select k, i, case when u < keep then slot else other end slot from d join t using (k, pos)"""
)
def sample_times_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = cube(spark, sf_dir).groupBy(F.col("service").alias("k"), "slot").agg(F.sum("value").alias("value"))
    p = C.share(sums, "k", name="p").select("k", "slot", "p")
    return M.sample_times_alias(p, "k", N_DRAWS).withColumn("i", F.col("i").cast("long"))


@query(f"with {CUBE}, {_profile_sql('service', 'cube')} select k service, {PROFILE_OUT} from sp group by k")
def time_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = cube(spark, sf_dir).groupBy(F.col("service").alias("k"), "slot").agg(F.sum("value").alias("value"))
    return _summary(_drawn(sums)).withColumnRenamed("k", "service")


@query(f"with {CUBE}, {CLASS}, cc as (select service, c, slot, v from cube join cls using (tile) where c <> 'q1'), {_profile_sql('service, c', 'cc')} select k service_class, {PROFILE_OUT} from sp group by k")
def time_profile_by_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest against highest class."""
    c = stored_cube(spark, sf_dir)
    classes = income_classes(incomes(spark, sf_dir, c), QS).where("income_class in ('q0', 'q2')")
    key = F.concat_ws(":", "service", "income_class").alias("k")
    return _summary(_drawn(c.join(classes, "tile").groupBy(key, "slot").agg(F.sum("value").alias("value")))).withColumnRenamed("k", "service_class")


@query(
    f"""with {CUBE}, {_profile_sql('service', 'cube')}, b as (select k, count(*) n, stddev_samp(slot) s, quantile_cont(slot::double, 0.75) - quantile_cont(slot::double, 0.25) iqr from sp group by 1),
h as (select k, n, greatest(0.9 * least(s, case when iqr > 0 then iqr / 1.34 else s end) * n ** -0.2, 0.5) h from b), p as (select unnest(range(0, 191)) / 2.0 as p)
select k service, cast(p as double) slot, round(sum(exp(-(((p - slot) / h) ** 2) / 2)) / any_value(h * n) / sqrt(2 * pi()), 6) density from sp join h using (k), p group by 1, 2"""
)
def time_profile_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of each service's times of day: a kernel density at every half slot."""
    sums = cube(spark, sf_dir).groupBy(F.col("service").alias("k"), "slot").agg(F.sum("value").alias("value"))
    got = density(cut_lineage(_drawn(sums)), "k", "slot", 0.0, 95.0, 191)
    return got.select(F.col("k").alias("service"), F.col("at").alias("slot"), R(F.col("density")).alias("density"))


@query(
    f"""with {CUBE}, {RATE}, smp(sample) as (select unnest(range(0, {N_SAMPLES}))), mr as (select sample, service, -(mb / 60) * ln(1 - {_u("'0:' || sample || ':' || service", 0)}) mr from rate cross join smp)
select cast(sample as int) as sample, city, service, round(sum(v / mr), 6) minutes_ from cube join mr using (service) group by 1, 2, 3"""
)
def screen_time_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With rates of another distribution, given by its inverse."""
    exponential = M.by_inverse(lambda u, mean: -mean * F.ln(1 - u))
    got = M.screen_time_samples(cube(spark, sf_dir), rates(spark), N_SAMPLES, "mean", sampler=exponential)
    return got.groupBy("sample", "city", "service").agg(R(F.sum("value")).alias("minutes_"))


@query(f"select o_orderkey, round({_normal('100.0', chr(39) + '5:' + chr(39) + ' || o_orderkey')}, 6) draw from orders")
def normal_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = S.clamped_normal(F.lit(100.0), F.lit(50.0), "5", F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R(draw).alias("draw"))
