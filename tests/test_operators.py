"""Small cases by hand: missing values, zero totals, edges, and properties of the operators."""

from __future__ import annotations

import math
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubespark.functions import scalars as S
from cubespark.operators import cube as C
from cubespark.operators import geometry as G2
from cubespark.operators import graph as G
from cubespark.operators import income as N
from cubespark.operators import indices as X
from cubespark.operators import mobility as M
from cubespark.operators import sampling as Z
from cubespark.operators import spatial as P
from cubespark.operators import stats as T
from cubespark.operators.ordered import running_total
from cubespark.sources import store

CUBE = "city string, tile long, service string, slot int, value double"


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(1)
    rows = [(f"c{c}", c * 10 + t, s, i, float(rng.randrange(9))) for c in range(2) for t in range(6) for s in "ab" for i in range(8) if rng.random() < 0.7]
    return spark.createDataFrame(rows, CUBE)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_absent_rows_count_as_zero_and_nulls_do_not_count(spark):
    cube = spark.createDataFrame([("c", 1, "a", 0, 4.0), ("c", 2, "a", 0, None), ("c", 1, "b", 0, 6.0), ("c", 3, "b", 0, None)], CUBE)
    got = C.mean_over(cube, "tile", "service", "slot", members=cube.select("tile"))
    assert rows(got, "service", "value") == [("a", 2.0), ("b", 3.0)]  # three tiles, one of them null
    assert rows(C.mean_over(cube, "tile", "service"), "service", "value") == [("a", 2.0), ("b", 3.0)]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert df.select(S.clean(F.col("x")).alias("x")).agg(F.sum("x"), F.count("x")).first()[:] == (1.0, 1)


def test_unit_without_traffic_has_index_zero_and_is_left_out_of_the_mean(spark):
    cube = spark.createDataFrame([("c", 1, "a", 0, 1.0), ("c", 2, "a", 4, 1.0), ("c", 3, "a", 2, 0.0)], CUBE)
    for f in (X.night_index, X.night_index_by_cdf):
        got = {r.tile: r.night_index for r in f(cube, "tile").collect()}
        if f is X.night_index:
            assert got == {1: -2.0, 2: 2.0, 3: 0.0}
        assert got[3] == 0 and not math.copysign(1, got[3]) < 0


def test_both_forms_of_the_index_agree_and_average_to_zero(toy):
    a, b = (({(r.city, r.tile): r.night_index for r in f(toy.where("slot >= 0"), "tile").collect()}) for f in (X.night_index, X.night_index_by_cdf))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert abs(sum(v for k, v in a.items() if k[0] == "c0")) < 1e-9
    again = {(r.city, r.tile): r.night_index for r in X.night_index(toy.repartition(7), "tile").collect()}
    assert all(abs(a[k] - again[k]) < 1e-9 for k in a)


def test_classes_are_closed_on_the_right_and_null_stays_out(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "tile long, log2_income double")
    assert rows(N.income_classes(df, [0.5]), "tile", "income_class") == [(1, "q0"), (2, "q0"), (3, "q1"), (4, None)]
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "tile long, log2_income double")
    assert rows(N.income_classes(same, [0.3, 0.7]), "income_class") == [("q0",), ("q0",)]
    admin = spark.createDataFrame([(1, 8.0, 2.0), (2, 0.0, 1.0), (3, -4.0, 1.0), (4, 1.0, 0.0)], "tile long, Ind_snv double, Ind double")
    assert rows(N.log2_income(admin), "tile", "log2_income") == [(1, 2.0), (2, None), (3, None), (4, None)]


def test_division_by_zero_is_null(spark):
    m = spark.createDataFrame([("r", "c", 0.0), ("r", "d", 0.0)], "row string, col string, value double")
    assert rows(X.comparative_advantage(m, "row", "col"), "rca") == [(None,), (None,)]
    assert rows(C.share(m, "row"), "share") == [(None,), (None,)]


def test_advantage_weighted_by_column_shares_is_one(toy):
    sums = toy.groupBy("tile", "service").agg(F.sum("value").alias("value"))
    got = X.comparative_advantage(sums, "tile", "service").toPandas()
    share = got.groupby("service").value.sum() / got.value.sum()
    for _, g in got.groupby("tile"):
        if g.value.sum():
            assert abs(sum(r.rca * share[r.service] for r in g.itertuples()) - 1) < 1e-9


def test_space_is_symmetric_with_ones_on_the_diagonal(toy):
    adv = X.comparative_advantage(toy.groupBy("tile", F.col("slot").cast("string").alias("service")).agg(F.sum("value").alias("value")), "tile", "service")
    got = {(r.a, r.b): r.proximity for r in X.service_space(adv, "tile", "service").collect()}
    assert all(got[a, b] == got[b, a] and 0 <= got[a, b] <= 1 for a, b in got if got[a, b] is not None)
    assert all(v in (1.0, None) for (a, b), v in got.items() if a == b) and len(got) == 64


def test_cyclic_slots_and_wrapping_windows(spark):
    t = spark.createDataFrame([("21:59:00",), ("22:00:00",), ("00:15:00",), ("06:00:00",)], "time string")
    assert rows(C.cyclic_slots(t), "slot", "time") == [(0, "22:00:00"), (1, "00:15:00"), (2, "06:00:00"), (3, "21:59:00")]
    c = t.withColumn("value", F.lit(1.0)).withColumn("k", F.lit(1))
    assert X.consumption_in_window(c, "21:59:30", "00:15:00", "k").first().value == 2.0
    assert spark.range(1).select(S.slot_to_clock(F.lit(8.5), 15, "22:00:00")).first()[0] == "00:08:00"  # 127.5 minutes, half to even


def test_strict_labels_and_concat(toy):
    with pytest.raises(ValueError, match="zz"):
        C.filter_labels(toy, "service", ["a", "zz"], strict=True)
    with pytest.raises(ValueError, match="slots"):
        C.concat_cubes(toy, toy.where("slot < 3"))
    assert C.concat_cubes(toy.where("service = 'a'"), toy.where("service = 'b'"), same_slots=False).count() == toy.count()
    assert C.max_abs_difference(toy, toy, "tile", "service", "slot").first()[0] == 0.0
    with pytest.raises(ValueError, match="technique"):
        Z.screen_time_samples(toy, toy, 1, "other")


@settings(max_examples=200, deadline=None)
@given(st.floats(-50, 150), st.floats(-50, 150), st.floats(1, 80), st.floats(1, 80))
def test_clipping_a_box_by_a_box(x, y, w, h):
    ring = np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    want = max(0, min(x + w, 100) - max(x, 0)) * max(0, min(y + h, 100) - max(y, 0))
    assert abs(G2.ring_areas(G2.clipped_to_box([ring], (0, 0, 100, 100))) - want) < 1e-6 * max(1, want)


def test_overlaps_buffers_and_conservation(spark):
    rng = random.Random(2)
    src = [(i, x := rng.uniform(-300, 300), y := rng.uniform(-300, 300), x + 100, y + 100) for i in range(60)]
    dst = [(i, 100.0 * (i % 8) - 400, 100.0 * (i // 8) - 400, 100.0 * (i % 8) - 300, 100.0 * (i // 8) - 300) for i in range(64)]
    schema = "key long, xmin double, ymin double, xmax double, ymax double"
    s, d = spark.createDataFrame(src, schema), spark.createDataFrame(dst, schema)
    want = {(a[0], b[0]): (min(a[3], b[3]) - max(a[1], b[1])) * (min(a[4], b[4]) - max(a[2], b[2])) for a in src for b in dst if min(a[3], b[3]) > max(a[1], b[1]) and min(a[4], b[4]) > max(a[2], b[2])}
    got = {(r.src, r.dst): r.area for r in P.box_overlaps(s, d, 130.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    values = s.select(F.col("key").alias("src"), F.lit(1.0).alias("v"))
    moved = P.regrid(values, P.box_overlaps(s, d, 130.0), 10_000.0, ["v"], "weighted_sum", least=-1.0).agg(F.sum("v")).first()[0]
    assert abs(moved - sum(want.values()) / 10_000) < 1e-9
    points = [("p", rng.uniform(-400, 400), rng.uniform(-400, 400)) for _ in range(80)]
    near = P.points_in_buffer(d, spark.createDataFrame(points, "code string, x double, y double"), 70.0, 90.0).groupBy("key").count()
    count = {b[0]: sum(max(b[1] - x, 0, x - b[3]) ** 2 + max(b[2] - y, 0, y - b[4]) ** 2 <= 4900 for _, x, y in points) for b in dst}
    assert {r.key: r["count"] for r in near.collect()} == {k: n for k, n in count.items() if n}
    triangle = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0)])], "key long, ring array<struct<x: double, y: double>>")
    inside = P.ring_overlaps(spark.createDataFrame([(5, 0.0, 0.0, 50.0, 50.0)], schema), triangle, 40.0)
    assert rows(inside, "src", "dst", "area") == [(5, 1, 2500.0)]
    assert triangle.select(P.ring_area(F.col("ring"))).first()[0] == 5000.0


def test_null_values_do_not_weigh(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0), (1, None, 9.0)], "dst long, v double, area double")
    assert P.perform_aggregation(df, ["v"], "weighted_mean", "dst").first().v == 4.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 20)), max_size=30), st.lists(st.integers(0, 20), max_size=30))
def test_count_below_is_searchsorted(spark, values, marks):
    v = spark.createDataFrame([(1, i, None if x is None else float(x)) for i, x in enumerate(values)], "g long, i long, x double")
    m = spark.createDataFrame([(1, float(x)) for x in marks], "g long, y double")
    got = {r.i: r.below for r in Z.count_below(v, m, ["g"], "x", "y").collect()}
    assert got == {i: None if x is None else int(np.searchsorted(sorted(marks), x)) for i, x in enumerate(values)}


def test_screen_time_grows_with_traffic_and_repeats(spark, toy):
    rates = spark.createDataFrame([("a", 60.0), ("b", 5.0)], "service string, mb_per_hour double")
    got = Z.screen_time_individual(toy, rates, 2).cache()
    assert rows(got, *got.columns) == rows(Z.screen_time_individual(toy.repartition(5), rates, 2), *got.columns)
    assert got.count() == 2 * toy.count() and got.where("value < 0").count() == 0
    zero = toy.withColumn("value", F.lit(0.0))
    assert Z.screen_time_individual(zero, rates, 1).agg(F.max("value")).first()[0] == 0.0


def test_commuting(spark):
    flows = spark.createDataFrame([("h", "w", 90), ("h", "h", 9), ("h", "x", 1)], "home string, work string, count long")
    trips = spark.createDataFrame([("h", "w", 1200, 6000)], "home string, work string, duration_seconds long, distance_meters long")
    modes = spark.createDataFrame([("h", 0.5)], "home string, car_share double")
    got = M.commute_duration(flows, trips, modes, 0.05).first().mean_seconds
    assert got == pytest.approx((90 * (0.5 * 1200 + 0.5 * 720) + 9 * (0.5 * 300 + 0.5 * 120)) / 100)


def test_regressions_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    want = np.linalg.lstsq(np.column_stack((np.ones(80), x)), y, rcond=None)[0]
    got = T.ols_models(df, "y", "a", {"g": ["b"], "h": ["c"]}, T.all_combinations(["g", "h"])).collect()
    assert [r.model for r in got] == ["none", "g", "h", "g+h"] and got[3].coefficient == pytest.approx(want[1])
    summary = {t: (c, e, p) for t, c, e, p in T.ols_summary(df, "y", ["a", "b", "c"])}
    assert summary["a"][0] == pytest.approx(want[1]) and summary["a"][1] == pytest.approx(got[3].std_error) and summary["a"][2] < 1e-6
    one = T.ols_simple(df, "a", "y").first()
    assert (one.slope, one.intercept) == pytest.approx(tuple(np.polyfit(x[:, 0], y, 1)))


def test_bins_hold_their_upper_end(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(11)], "x double, y double")
    assert rows(T.binned_mean(df, "x", "y", 5), "bin", "n") == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 3)]
    assert T.zscore(df, "x", quantile=0.5).count() == 6


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 1000))
def test_spanning_forest_is_kruskals(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(9), 2))): round(rng.random(), 1) for _ in range(12)}.items())
    parent = list(range(9))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = set()
    for (a, b), w in sorted(edges, key=lambda e: (-e[1], e[0])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b, w))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges], "a long, b long, w double")
    assert {tuple(r) for r in G.maximum_spanning_forest(df).collect()} == want
    assert {tuple(r) for r in G.maximum_spanning_forest(df, 0).collect()} == want


def test_backbone_and_union(spark):
    star = spark.createDataFrame([(0, i, 10.0 if i == 1 else 0.1) for i in range(1, 8)] + [(8, 9, 1.0)], "a long, b long, w double")
    kept = G.disparity_backbone(star)
    assert rows(kept, "a", "b") == [(0, 1)]
    assert G.union_max(kept, star.withColumn("w", F.lit(0.5))).where("a = 0 and b = 1").first().w == 10.0


def test_round_trips(spark):
    path = store.shared_path(spark, "t")
    store.write_csv(spark.createDataFrame([("007", 1.5), (None, None)], "code string, v double"), path)
    assert rows(store.read_csv(spark, path, "code string, v double"), "code", "v") == [("007", 1.5), (None, None)]
    lines = spark.createDataFrame([(" 50%|##| 17/34 [01:40<01:41, 5.9s/it]",), ("no mark",), (None,)], "line string")
    assert [r.seconds for r in store.log_durations(lines).collect()] == [100]


def test_controls_that_depend_on_each_other_share_their_effect(spark):
    rng = np.random.default_rng(5)
    n = 300
    a, b, x = rng.normal(100, 5, n), rng.normal(0, 1, n), rng.normal(3, 2, n)
    y = 2 * x - a + 0.5 * b + rng.normal(0, 1, n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, a, b, a, 1 - a, y, strict=True)], "x double, a double, b double, a2 double, rest double, y double").repartition(5)
    size, r = T.triangle(df, "y", ["x", "a", "b", "a2", "rest"])
    full = np.column_stack((np.ones(n), x, a, b, a, 1 - a))
    for use in ([0, 1, 2], [0, 1, 2, 3], [0, 1, 3, 4], [1, 3], [0, 1, 2, 3, 4]):
        columns = full[:, [0, *[1 + i for i in use]]]
        beta, errors, r2, rank = T.solve(size, r, use)
        want, _, want_rank, _ = np.linalg.lstsq(columns, y, rcond=None)
        rss = ((y - columns @ want) ** 2).sum()
        assert size == n and rank == want_rank == min(len(use) + 1, np.linalg.matrix_rank(columns))
        assert np.allclose(beta, want, atol=1e-8) and abs(r2 - (1 - rss / ((y - y.mean()) ** 2).sum())) < 1e-9
        assert np.allclose(errors**2, np.diag(np.linalg.pinv(columns.T @ columns, rcond=1e-12)) * rss / (n - rank), rtol=1e-5)
    models = T.ols_models(df, "y", "x", {"one": ["a"], "two": ["a2", "rest"]}, T.all_combinations(["one", "two"])).collect()
    got = {m.model: m.coefficient for m in models}
    assert got["one"] == pytest.approx(got["one+two"]) and got["two"] == pytest.approx(got["one"])
    assert T.triangle(df.limit(0), "y", ["x"])[0] == 0
    summary = {t: (c, p) for t, c, _, p in T.ols_summary(df, "y", ["x", "a", "b"])}
    assert summary["x"][1] < 1e-12 and summary["x"][0] == pytest.approx(2, abs=0.2)


def test_p_values_of_a_simple_fit(spark):
    assert T.ols_simple(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double"), "x", "y").first().p_value == 0.0
    assert T.ols_simple(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y").first().p_value is None
    one = T.ols_simple(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (3.0, 3.0), (None, 1.0)], "x double, y double"), "x", "y").first()
    t = one.slope / math.sqrt(sum((y - one.intercept - one.slope * x) ** 2 for x, y in ((0, 0), (1, 1), (2, 1), (3, 3))) / 2 / 5)
    assert one.n == 4 and one.p_value == pytest.approx(1 - t / math.sqrt(2 + t * t))  # in closed form for two degrees of freedom


def test_density_equals_summed_kernels_and_integrates_to_one(spark):
    rng = random.Random(9)
    data = {"a": [rng.gauss(5, 1) for _ in range(400)], "b": [rng.choice([2.0, 2.5, 7.0]) for _ in range(90)], "c": [4.0] * 5}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in [*x, None]], "k string, x double")
    got = T.density(df, "k", "x", 0.0, 10.0, 401).collect()
    for k, x in data.items():
        own = {r["at"]: r.density for r in got if r.k == k}
        assert len(own) == 401 and sum(own.values()) * 0.025 == pytest.approx(1, abs=0.01)
        q = np.quantile(x, [0.25, 0.75])
        std = np.std(x, ddof=1)
        h = max(0.9 * min(std, (q[1] - q[0]) / 1.34 if q[1] > q[0] else std) * len(x) ** -0.2, 0.025)
        want = {at: np.mean(np.exp(-(((at - np.array(x)) / h) ** 2) / 2)) / h / math.sqrt(2 * math.pi) for at in own}
        if h > 0.1:  # linear binning is as fine as the places are to the bandwidth
            assert all(abs(own[at] - want[at]) < 0.01 * max(want.values()) for at in own)


def test_counts_below_a_value_that_most_rows_have(spark):
    rng = random.Random(12)
    values = [(rng.choice("ab"), i, rng.choice([0.0] * 18 + [None, rng.uniform(0, 9)])) for i in range(400)]
    marks = [(g, rng.uniform(-1, 9)) for g in "ab" for _ in range(60)] + [("a", 0.0), ("c", 1.0)]
    got = Z.count_below(spark.createDataFrame(values, "g string, i long, v double"), spark.createDataFrame(marks, "g string, m double"), ["g"], "v", "m").collect()
    want = {i: None if v is None else sum(h == g and m < v for h, m in marks) for g, i, v in values}
    assert {r.i: r.below for r in got} == want and len(got) == 400


def test_a_value_of_most_rows_is_one_row_of_the_running_count(spark, monkeypatch):
    seen = []
    plain = Z.running_total
    monkeypatch.setattr(Z, "running_total", lambda rows, *more: seen.append(rows.count()) or plain(rows, *more))
    values = spark.range(5000).select(F.lit("a").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("double").alias("v"))
    Z.count_below(values, spark.createDataFrame([("a", 3.0)], "g string, m double"), ["g"], "v", "m").collect()
    assert seen == [500 + 1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.sampled_from([0.0, -0.0, 5e-324, 1.0, 1.0 + 2**-52, -1e300])), min_size=1, max_size=60))
def test_quantiles_of_any_doubles(spark, values):
    got = C.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", [0.0, 0.3, 0.5, 1.0]).first()
    order = sorted(values)
    for q, v in zip([0.0, 0.3, 0.5, 1.0], got, strict=True):
        at = q * (len(order) - 1)
        low, high = order[math.floor(at)], order[math.ceil(at)]
        want = low if math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
        assert v == pytest.approx(want, rel=1e-12, abs=0)


def test_alias_tables_hold_the_weights(spark):
    rng = random.Random(14)
    weights = {k: [rng.choice([0.0, rng.random(), 5 * rng.random() ** 4]) for _ in range(rng.randint(1, 40))] for k in range(25)} | {97: [1.0] * 7, 98: [0.0, 2.0], 99: [3.0]}
    df = spark.createDataFrame([(k, i, w) for k, x in weights.items() for i, w in enumerate(x)], "k long, slot int, p double")
    tables = {r.k: r.table for r in Z.alias_tables(df, "k").collect()}
    for k, x in weights.items():
        if not sum(x):
            assert k not in tables
            continue
        held = dict.fromkeys(range(len(x)), 0.0)
        for e in tables[k]:
            assert -1e-9 <= e.keep <= 1 + 1e-9
            held[e.slot] += e.keep / len(tables[k])
            held[e.other] += (1 - e.keep) / len(tables[k])
        assert len(tables[k]) == sum(w > 0 for w in x) and all(abs(held[i] - w / sum(x)) < 1e-9 for i, w in enumerate(x))
    drawn = Z.sample_times_alias(df.where("k = 1"), "k", 20000)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate ")]
    counts = {r.slot: r["count"] / 20000 for r in drawn.groupBy("slot").count().collect()}
    assert all(abs(counts.get(i, 0) - w / sum(weights[1])) < 0.015 for i, w in enumerate(weights[1]))


def test_draws_by_an_inverse(spark):
    mean = spark.range(4000).select(Z.by_inverse(lambda u, m: -m * F.ln(1 - u))(F.lit(3.0), "9", F.col("id")).alias("d"))
    got = [r.d for r in mean.collect()]
    assert np.mean(got) == pytest.approx(3, rel=0.05) and np.mean(np.array(got) > 3) == pytest.approx(math.exp(-1), abs=0.02)


def test_projection_of_a_known_point(spark):
    x, y = spark.range(1).select(*S.lambert93(F.lit(3.0), F.lit(46.5))).first()
    assert (x, y) == (pytest.approx(700000, abs=0.01), pytest.approx(6600000, abs=0.5))


def test_quantiles_equal_numpy_in_groups_with_ties_and_gaps(spark):
    rng = random.Random(4)
    data = [("a", float(rng.randrange(9))) for _ in range(200)] + [("b", 3.0)] * 150 + [("b", rng.random()) for _ in range(7)]
    data += [("c", None)] * 3 + [(None, 2.0), (None, 4.0), ("d", 1.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, x double")
    qs = [0.0, 0.1, 0.3, 0.5, 0.77, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(qs))] for r in C.quantiles(df, "x", qs, ("g",)).collect()}
    for g in {g for g, _ in data}:
        values = [x for h, x in data if h == g and x is not None]
        assert got[g] == (pytest.approx(list(np.quantile(values, qs))) if values else [None] * len(qs))
    everything = C.quantiles(df, "x", qs).collect()
    assert len(everything) == 1 and list(everything[0]) == pytest.approx(list(np.quantile([x for _, x in data if x is not None], qs)))
    assert [list(r) for r in C.quantiles(df.where("g = 'c'"), "x", [0.5]).collect()] == [[None]]


def shaken(df, column):
    """A column that differs in its last digits each time it is read, as a sum of doubles does on several machines."""
    shake = F.udf(lambda v: v * (1 + 1e-12 * random.SystemRandom().random()), "double").asNondeterministic()
    return df.withColumn(column, shake(F.col(column)))


def test_quantiles_are_of_values_read_once(spark):
    df = shaken(spark.range(1000).select((F.col("id") % 10 + 1.3).alias("x")), "x")
    for _ in range(3):
        assert list(C.quantiles(df, "x", [0.05, 0.4, 0.55, 0.95]).first()) == pytest.approx([1.3, 4.9, 6.3, 10.3], rel=1e-11)


def test_bands_of_sums_that_differ_between_readings(spark):
    df = shaken(spark.range(500).select("id", (F.col("id") % 10 + 1.3).alias("x"), (9.7 - F.col("id") % 10).alias("y")), "x")
    want = {i: "high_low" if i % 10 > 5 else "low_high" for i in range(500) if i % 10 not in (4, 5)}
    for inclusive in (True, False):
        assert {r.id: r.band for r in C.quantile_bands(df, ("x", 0.6), ("y", 0.4), inclusive).collect()} == want


def test_outliers_are_by_the_values_that_are_returned(spark):
    df = shaken(spark.range(101).select(F.col("id").cast("int").alias("id"), (F.col("id") + 0.3).alias("x")), "x")
    for _ in range(3):
        assert sorted(r.id for r in T.without_outliers(df, 0.5, "x").collect()) == list(range(51))


def test_a_strict_band_leaves_out_values_that_equal_its_edge(spark):
    df = spark.range(8).select("id", F.lit(1.3).alias("x"), F.col("id").cast("double").alias("y"))
    assert C.quantiles(df, "x", [0.4]).first() == (1.3,)
    assert C.quantile_bands(df, ("x", 0.6), ("y", 0.4), False).collect() == []


def test_running_totals_over_ranges_equal_plain_sums(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.randrange(40), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, o int, i int, x int").repartition(3)
    got = {(r.g, r.i): r.t for r in running_total(df, ["g"], ["o", "i"], F.col("x"), "t").collect()}
    whole = {r.i: r.t for r in running_total(df, [], ["o", "i"], F.col("x"), "t").collect()}
    for g, o, i, _ in data:
        assert got[g, i] == sum(x for h, p, j, x in data if h == g and (p, j) <= (o, i))
        assert whole[i] == sum(x for _, p, j, x in data if (p, j) <= (o, i))


def test_advantage_needs_no_window_and_takes_null_labels(spark):
    df = spark.createDataFrame([("r", "x", 2.0), ("r", None, 2.0), (None, "x", 4.0), (None, None, 0.0)], "a string, b string, value double")
    got = X.comparative_advantage(df, "a", "b")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "a", "b", "rca") == sorted([("r", "x", 2 / 6 / (4 / 8)), ("r", None, 2.0), (None, "x", 4 / 6 / (4 / 8)), (None, None, 0.0)], key=str)


def test_ticks_in_blocks_are_one_running_sum(spark, monkeypatch):
    groups = spark.createDataFrame([(0, "c", "s", 60.0, 40.0), (0, "d", "s", 60.0, 3.0)], "sample int, city string, service string, mb_per_hour double, most double")
    whole = {(r.city, r.i): r.cum for r in Z.ticks(groups, "0").collect()}
    monkeypatch.setattr(Z, "BLOCK", 16)
    split = {(r.city, r.i): r.cum for r in Z.ticks(groups, "0").collect()}
    assert split == pytest.approx(whole) and len(whole) == 124 + 69


def test_intermediate_tables_can_be_deleted(spark, toy):
    kept = store.cut_lineage(toy)
    assert kept.count() == toy.count() and store.clear(spark) >= 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        kept.count()
    assert store.clear(spark) == 0


def test_shuffle_files_go_with_their_write(spark, toy):
    """They would else stay until the driver collects its garbage, and a job of many tables would hold the shuffles of all."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def blocks() -> set[str]:
        found = disk.getAllBlocks()
        return {b.name() for b in map(found.apply, range(found.size())) if b.isShuffle()}

    held = [toy.repartition(3, "tile").groupBy("tile").count() for _ in range(3)]
    before, until = blocks(), time.time() + 20
    kept = [store.cut_lineage(x) for x in held]
    while (left := blocks() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and all(x.count() == y.count() for x, y in zip(held, kept, strict=True))
    assert spark.conf.get(store._CLEANUP) == "false"  # a user's own queries keep theirs


def test_a_discarded_table_is_deleted_alone(spark, toy):
    one, two = store.cut_lineage(toy), store.cut_lineage(toy)
    path = one.inputFiles()[0].removeprefix("file://")
    store.discard(one, toy)  # toy is none of ours
    store.discard(one)
    assert not os.path.exists(path) and two.count() == toy.count()
