"""Regressions, bins, scores and backbones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions.scalars import rounded
from cubespark.operators import graph as G
from cubespark.operators import stats as T
from cubespark.queries.base import query, table
from cubespark.queries.indices import SPACE, space

R = rounded


def regression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: y the mean order price, x the balance, and 14 control columns in six groups."""
    o = table(spark, sf_dir, "orders")
    date, price = F.col("o_orderdate"), F.col("o_totalprice")
    counts = {f"p{i}": F.col("o_orderpriority") == p for i, p in enumerate(("1-URGENT", "2-HIGH", "5-LOW"))}
    counts |= {f"s{s.lower()}": F.col("o_orderstatus") == s for s in ("F", "O")} | {f"q{i}": F.quarter(date) == i for i in (1, 2, 3)}
    counts |= {"n": F.lit(True), "weekend": F.dayofweek(date).isin(1, 7)}
    sums = [F.count_if(c).cast("double").alias(name) for name, c in counts.items()]
    per = o.groupBy(F.col("o_custkey").alias("key")).agg(F.avg(price).alias("y"), F.min(price).alias("lo"), F.max(price).alias("hi"), *sums)
    nation = F.col("c_nationkey").cast("double")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("x"), nation.alias("nation"), (nation % 5).alias("zone"))
    return per.join(c, "key")


REG = """reg as materialized (select o_custkey key, avg(o_totalprice) y, any_value(c_acctbal) x, any_value(c_nationkey)::double nation, any_value(c_nationkey % 5)::double "zone",
  min(o_totalprice) lo, max(o_totalprice) hi,
  count(*) filter (where o_orderpriority = '1-URGENT')::double p0, count(*) filter (where o_orderpriority = '2-HIGH')::double p1, count(*) filter (where o_orderpriority = '5-LOW')::double p2,
  count(*) filter (where o_orderstatus = 'F')::double sf, count(*) filter (where o_orderstatus = 'O')::double so,
  count(*) filter (where quarter(o_orderdate) = 1)::double q1, count(*) filter (where quarter(o_orderdate) = 2)::double q2, count(*) filter (where quarter(o_orderdate) = 3)::double q3,
  count(*)::double n, count(*) filter (where dayofweek(o_orderdate) in (0, 6))::double weekend
  from orders join customer on o_custkey = c_custkey group by 1)"""
GROUPS = {"urgency": ["p0", "p1", "p2"], "status": ["sf", "so"], "place": ["nation", "zone"], "price": ["lo", "hi"], "season": ["q1", "q2", "q3"], "habit": ["n", "weekend"]}


def _fit_sql(name: str, term: str, others: list[str]) -> str:
    """Coefficient b, standard error se and rss of a term of the regression of y, by successive partialling out of the others, one
    column after another. The intercept is the column ``one``."""
    columns, steps = [*others, term, "y"], [f"{name}_0 as (select 1.0::double as one, * exclude (key) from reg)"]
    for k, c in enumerate(others):
        rest = ", ".join(f"{r} - {c} * (sum({r} * {c}) over () / sum({c} * {c}) over ()) as {r}" for r in columns[k + 1 :])
        steps.append(f"{name}_{k + 1} as (select {rest} from {name}_{k})")
    steps.append(f"{name}_s as (select sum({term} * y) / sum({term} * {term}) b, sum({term} * {term}) t, sum(y * y) yy, count(*) - {len(others) + 1} free from {name}_{len(others)})")
    steps.append(f"{name} as (select b, sqrt((yy - b * b * t) / free / t) se, yy - b * b * t rss, free from {name}_s)")
    return ", ".join(steps)


def _p_sql(name: str) -> str:
    """The two-sided p-value of a fitted term: Student's density integrated by Simpson's rule."""
    density = f"exp(lgamma((free + 1) / 2.0) - lgamma(free / 2.0)) / sqrt(free * pi()) * (1 + (abs(b / se) * i / 4000) ** 2 / free) ** (-(free + 1) / 2.0)"
    weight = "case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(select 1 - 2 * sum({weight} * {density} * abs(b / se) / 4000 / 3) from {name}, range(0, 4001) r(i))"


def _models_sql(models: list[tuple[str, ...]], groups: dict[str, list[str]]) -> str:
    """The regressions of y on x and each model's groups. The columns of one group after another are taken out of all others, along a
    tree of the groups in their order, so that models share what they begin with."""
    names = list(groups)
    steps = ["b_ as (select 1.0::double as one, * exclude (key) from reg)"]

    def without(source: str, column: str, kept: list[str], name: str) -> str:
        rest = ", ".join(f"{r} - {column} * (sum({r} * {column}) over () / sum({column} * {column}) over ()) as {r}" for r in kept)
        steps.append(f"{name} as materialized (select {rest} from {source})")
        return name

    def node(model: tuple[str, ...]) -> str:
        later = [c for g in names[names.index(model[-1]) + 1 if model else 0 :] for c in groups[g]]
        if model not in known:
            source = node(model[:-1]) if model else "b_"
            columns = groups[model[-1]] if model else ["one"]
            for k, c in enumerate(columns):
                source = without(source, c, [*columns[k + 1 :], *later, "x", "y"], f"t{len(known)}_{k}")
            known[model] = source
        return known[model]

    known, rows = {}, []
    for model in models:
        n = sum(len(groups[g]) for g in model)
        source = node(model)
        fit = f"select sum(x * y) / sum(x * x) b, sum(x * x) t, sum(y * y) - sum(x * y) ** 2 / sum(x * x) rss, count(*) - {n + 2} free from {source}"
        rows.append(f"select '{'+'.join(model) or 'none'}' model, cast({n} as int) n_controls, round(b, 4) coefficient, round(sqrt(rss / free / t), 4) std_error, round(1 - rss / yss, 4) r2 from ({fit}), tss")
    return f"with {REG}, tss as (select var_pop(y) * count(*) yss from reg), {', '.join(steps)} {' union all '.join(rows)}"


@query(
    f"""with {REG}, {_fit_sql('f', 'x', ['one'])}
select round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 3) intercept, round(regr_r2(y, x), 6) r2, cast(regr_count(y, x) as bigint) n, round({_p_sql('f')}, 5) p_value from reg"""
)
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.ols_simple(regression_table(spark, sf_dir), "x", "y")
    return got.select(R(F.col("slope")).alias("slope"), R(F.col("intercept"), 3).alias("intercept"), R(F.col("r2")).alias("r2"), "n", R(F.col("p_value"), 5).alias("p_value"))


def _models(spark: SparkSession, sf_dir: str, groups: dict[str, list[str]], models: list[tuple[str, ...]]) -> DataFrame:
    got = T.ols_models(regression_table(spark, sf_dir), "y", "x", groups, models)
    return got.select("model", "n_controls", *[R(F.col(c), 4).alias(c) for c in ("coefficient", "std_error", "r2")])


PLACE = {"place": GROUPS["place"]}


@query(_models_sql(T.nested(["place"]), PLACE))
def ols_nested_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested models of one group."""
    return _models(spark, sf_dir, PLACE, T.nested(list(PLACE)))


@query(_models_sql(T.nested(list(GROUPS)), GROUPS))
def ols_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, GROUPS, T.nested(list(GROUPS)))


@query(_models_sql(T.all_combinations(list(GROUPS)), GROUPS))
def ols_all_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, GROUPS, T.all_combinations(list(GROUPS)))


CONTROLLED = ["x", "p0", "p1", "p2", "nation"]


def _controls_sql() -> str:
    fits = [_fit_sql(f"f{k}", c, ["one", *[o for o in CONTROLLED if o != c]]) for k, c in enumerate(CONTROLLED)] + [_fit_sql("fi", "one", CONTROLLED)]
    names = [*[(f"f{k}", c) for k, c in enumerate(CONTROLLED)], ("fi", "intercept")]
    rows = [f"select '{term}' term, round(b, 4) coefficient, round(se, 4) std_error, round({_p_sql(f)}, 4) + 0 p_value from {f}" for f, term in names]
    return f"with {REG}, {', '.join(fits)} {' union all '.join(rows)}"


@query(_controls_sql())
def ols_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With p-values."""
    rows = T.ols_summary(regression_table(spark, sf_dir), "y", CONTROLLED)
    got = spark.createDataFrame([(a, float(b), float(c), float(d)) for a, b, c, d in rows], "term string, coefficient double, std_error double, p_value double")
    return got.select("term", *[R(F.col(c), 4).alias(c) for c in ("coefficient", "std_error", "p_value")])


_BIN = "cast(least(floor((x - e.lo) / (e.hi - e.lo) * 8) + 1, 8) as bigint)"


@query(
    f"""with {REG}, e as (select min(x) lo, max(x) hi, min(y) yl, max(y) yh from reg)
select {_BIN} xbin, cast(least(floor((y - yl) / (yh - yl) * 6) + 1, 6) as bigint) ybin, count(*) n from reg, e group by 1, 2"""
)
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.histogram2d(regression_table(spark, sf_dir), "x", "y", 8, 6)


@query(
    f"""with {REG}, q as (select quantile_cont(x, 0.99) a, quantile_cont(y, 0.99) b from reg), k as (select x, y from reg, q where x <= a and y <= b),
e as (select min(x) lo, max(x) hi from k) select {_BIN} bin, round(avg(y), 4) mean, count(*) n from k, e group by 1"""
)
def binned_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = T.without_outliers(regression_table(spark, sf_dir).select("x", "y"), 0.99, "x", "y")
    return T.binned_mean(kept, "x", "y", 8).select("bin", R(F.col("mean"), 4).alias("mean"), "n")


@query(
    f"""with {REG}, k as (select sqrt(y) x, y from reg), e as (select min(x) lo, max(x) hi from k) select {_BIN} bin, round(avg(y), 4) mean, count(*) n from k, e group by 1"""
)
def binned_mean_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of equal width in the square root."""
    return T.binned_mean(regression_table(spark, sf_dir), "y", "y", 8, F.sqrt).select("bin", R(F.col("mean"), 4).alias("mean"), "n")


@query(
    f"""with {REG}, m as (select avg(y) a, stddev_samp(y) s from reg), e as (select min(x) lo, max(x) hi from reg)
select {_BIN} bin, round(avg((y - a) / s), 6) + 0 mean, count(*) n from reg, m, e group by 1"""
)
def binned_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = T.zscore(regression_table(spark, sf_dir), "y")
    return T.binned_mean(z, "x", "z", 8).select("bin", R(F.col("mean")).alias("mean"), "n")


@query(f"with {REG}, k as (select key, y from reg, (select quantile_cont(y, 0.95) q from reg) where y <= q), m as (select avg(y) a, stddev_samp(y) s from k) select key, round((y - a) / s, 6) + 0 z from k, m")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.zscore(regression_table(spark, sf_dir).select("key", "y"), "y", quantile=0.95).select("key", R(F.col("z")).alias("z"))


#: Brands are close to each other; at the default of 0.16 no edge would stand out.
ALPHA = 0.35
EDGES = f"{SPACE}, ed as (select a, b, proximity w from space where a < b and proximity <> 0)"
BACKBONE = f"""{EDGES}, bw as (select a, b, w from ed union all select b, a, w from ed), st as (select a, sum(w) s, count(*) k from bw group by 1),
bb as (select a, b, w from ed join st x using (a) join st y on y.a = ed.b where (x.k > 1 and (1 - w / x.s) ** (x.k - 1) < 0.35) or (y.k > 1 and (1 - w / y.s) ** (y.k - 1) < 0.35))"""
#: Kruskal's rule: an edge belongs to the forest unless its ends are joined by edges before it in the total order.
FOREST = """eo as (select *, row_number() over (order by w desc, a, b) o from ed),
walk(o, v) as (select o, a from eo union select walk.o, case when e.a = walk.v then e.b else e.a end from walk join eo e on e.o < walk.o and (e.a = walk.v or e.b = walk.v)),
forest as (select a, b, w from eo where not exists (select 1 from walk where walk.o = eo.o and walk.v = eo.b))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_of(space(spark, sf_dir))


@query(f"with {BACKBONE} select a, b, round(w, 6) w from bb")
def backbone_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.disparity_backbone(edges(spark, sf_dir), ALPHA).select("a", "b", R(F.col("w")).alias("w"))


@query(f"with recursive {EDGES}, {FOREST} select a, b, round(w, 6) w from forest")
def backbone_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.maximum_spanning_forest(edges(spark, sf_dir)).select("a", "b", R(F.col("w")).alias("w"))


@query(f"with recursive {BACKBONE}, {FOREST} select a, b, round(max(w), 6) w from (select * from bb union all select * from forest) group by 1, 2")
def backbone_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return G.union_max(G.disparity_backbone(e, ALPHA), G.maximum_spanning_forest(e)).select("a", "b", R(F.col("w")).alias("w"))
