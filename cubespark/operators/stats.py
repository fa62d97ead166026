"""Regressions, bins, densities and standard scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.functions.scalars import equal_width_bin
from cubespark.operators.cube import quantiles
from cubespark.operators.ordered import join_on
from cubespark.sources.store import cut_lineage

#: Tasks whose triangles meet in one, in the reduction tree of triangle().
FAN = 64


def student_p(t: float, free: float) -> float:
    """The two-sided p-value of Student's distribution: an incomplete beta function, by its continued fraction."""
    if math.isnan(t) or free <= 0:
        return math.nan
    a, b, x = free / 2, 0.5, free / (free + t * t)
    if x >= 1 or x <= 0:
        return float(x >= 1)
    if swap := x > (a + 1) / (a + b + 2):
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method: numerator and denominator ratios of the convergents.
    c, d, value, tiny = 1.0, 0.0, 1.0, 1e-300
    for m in range(400):
        k = m // 2
        if m == 0:
            term = 1.0
        elif m % 2 == 0:
            term = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            term = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if m and abs(c * d - 1) < 1e-15:
            break
    p = front * (value - 1)
    return 1 - p if swap else p


def ols_simple(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r2, n, and the slope's two-sided p_value of y on x; all from one pass over the table."""
    fit = table.agg(F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_r2(y, x), F.regr_count(y, x)).first()
    slope, intercept, r2, n = fit
    p = None
    if r2 is not None and n > 2:
        p = student_p(math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2) if r2 < 1 else 0.0
    return table.sparkSession.createDataFrame([(slope, intercept, r2, n, p)], "slope double, intercept double, r2 double, n long, p_value double")


def _triangles(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The triangle R of a task's rows: of the columns ``names`` with a one before them, or of other tasks' triangles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((0, len(names) + 1))
        for batch in batches:
            if "r" in batch.schema.names:
                n += int(np.sum(batch["n"].to_numpy()))
                rows = batch["r"].flatten().to_numpy().reshape(-1, len(names) + 1)
            else:
                n += batch.num_rows
                rows = np.column_stack([np.ones(batch.num_rows), *[batch[c].to_numpy(zero_copy_only=False) for c in names]])
            if len(rows):
                r = np.linalg.qr(np.vstack((r, rows)), mode="r")
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] + [0] * (len(r) - 1)), pa.array(list(r))], ["n", "r"])

    return run


def triangle(table: DataFrame, y: str, xs: list[str]) -> tuple[int, np.ndarray]:
    """The number of complete rows, and the triangle R of the QR decomposition of (1, xs, y): all that any regression of y on some of xs
    needs, without the loss of digits of sums of products.

    Each task reduces its rows to one triangle, FAN groups of tasks reduce those, and FAN triangles at most come to the driver."""
    names = [*xs, y]
    rows = table.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).na.drop()
    names, schema = rows.columns, "n long, r array<double>"
    parts = rows.mapInArrow(_triangles(names), schema).repartition(FAN, F.spark_partition_id()).mapInArrow(_triangles(names), schema).toArrow()
    size = len(names) + 1
    if not parts.num_rows:
        return 0, np.zeros((size, size))
    r = np.linalg.qr(np.array(parts["r"].to_pylist(), float).reshape(-1, size), mode="r")
    return int(np.sum(parts["n"].to_numpy())), np.vstack((r, np.zeros((size - len(r), size))))


def solve(n: int, r: np.ndarray, use: list[int]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Coefficients (that of the intercept first), standard errors, R2 and the rank of the regression on columns ``use`` of triangle()'s.

    Columns that depend on others share their effect: it is the solution of least norm, whose rank counts for the degrees of freedom."""
    a, b = r[:, [0, *[1 + i for i in use]]], r[:, -1]
    cut = np.finfo(float).eps * max(n, a.shape[1])
    beta, _, rank, _ = np.linalg.lstsq(a, b, rcond=cut)
    rss, tss, free = float(np.sum((b - a @ beta) ** 2)), float(np.sum(b[1:] ** 2)), n - int(rank)
    inverse = np.linalg.pinv(a, rcond=cut)
    errors = np.sqrt(np.sum(inverse**2, axis=1) * rss / free) if free > 0 else np.full(a.shape[1], np.nan)
    return beta, errors, 1 - rss / tss if tss else math.nan, int(rank)


def ols_summary(table: DataFrame, y: str, xs: list[str]) -> list[tuple[str, float, float, float]]:
    """(term, coefficient, std_error, p_value) of a least-squares fit, intercept last."""
    n, r = triangle(table, y, xs)
    beta, errors, _, rank = solve(n, r, list(range(len(xs))))
    rows = [(t, float(b), float(e), student_p(b / e, n - rank) if e else 0.0) for t, b, e in zip(["intercept", *xs], beta, errors, strict=True)]
    return [*rows[1:], rows[0]]


def ols_models(table: DataFrame, y: str, x: str, groups: dict[str, list[str]], models: list[tuple[str, ...]]) -> DataFrame:
    """(model, n_controls, coefficient, std_error, r2) of x for each list of control groups; one pass over the table for all."""
    controls = list(dict.fromkeys(c for g in groups.values() for c in g))
    n, r = triangle(table, y, [x, *controls])
    out = []
    for model in models:
        used = list(dict.fromkeys(c for name in model for c in groups[name]))
        beta, errors, r2, _ = solve(n, r, [0, *[1 + controls.index(c) for c in used]])
        out.append(("+".join(model) or "none", len(used), float(beta[1]), float(errors[1]), float(r2)))
    return table.sparkSession.createDataFrame(out, "model string, n_controls int, coefficient double, std_error double, r2 double")


def nested(names: list[str]) -> list[tuple[str, ...]]:
    return [tuple(names[:k]) for k in range(len(names) + 1)]


def all_combinations(names: list[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(names) + 1) for c in combinations(names, k)]


def without_outliers(table: DataFrame, quantile: float, *columns: str) -> DataFrame:
    """Rows whose columns are all at most their own quantile."""
    kept = table = cut_lineage(table)  # the quantiles are of these very values
    for c in columns:
        cut = quantiles(table, c, [quantile]).toDF(f"_cut_{c}")
        kept = kept.crossJoin(F.broadcast(cut)).where(F.col(c) <= F.col(f"_cut_{c}")).drop(f"_cut_{c}")  # one row
    return kept


def zscore(table: DataFrame, column: str, name: str = "z", quantile: float | None = None) -> DataFrame:
    """Add the standard score, with the sample deviation, of the rows at or below a quantile (all by default)."""
    rows = without_outliers(table, quantile, column) if quantile is not None else table
    moments = rows.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return rows.crossJoin(F.broadcast(moments)).withColumn(name, F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def binned(table: DataFrame, column: str, n: int, name: str = "bin", rescale: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the equal-width bin, from 1, between the column's extremes; of the column as ``rescale`` makes it, if that is given."""
    if rescale is not None:
        return binned(table.withColumn("_rescaled", rescale(F.col(column))), "_rescaled", n, name).drop("_rescaled")
    ends = table.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    rows = table.crossJoin(F.broadcast(ends))  # one row
    return rows.withColumn(name, equal_width_bin(F.col(column).cast("double"), F.col("_lo"), F.col("_hi"), n)).drop("_lo", "_hi")


def histogram2d(table: DataFrame, x: str, y: str, nx: int, ny: int, rescale: Callable[[Column], Column] | None = None) -> DataFrame:
    return binned(binned(table, x, nx, "xbin", rescale), y, ny, "ybin", rescale).groupBy("xbin", "ybin").agg(F.count("*").alias("n"))


def binned_mean(table: DataFrame, x: str, y: str, n: int, rescale: Callable[[Column], Column] | None = None) -> DataFrame:
    return binned(table, x, n, rescale=rescale).groupBy("bin").agg(F.avg(y).alias("mean"), F.count("*").alias("n"))


def silverman(n: Column, std: Column, iqr: Column) -> Column:
    """The bandwidth by Silverman's rule; by the deviation alone where the quartiles are equal."""
    spread = F.least(std, F.when(iqr > 0, iqr / 1.34).otherwise(std))
    return 0.9 * spread * F.pow(n, F.lit(-0.2))


def density(samples: DataFrame, unit: str, x: str, low: float, high: float, points: int) -> DataFrame:
    """(unit, at, density): a Gaussian kernel density of each unit's values, at ``points`` equally spaced places from ``low`` to ``high``,
    by linear binning: a value gives its weight to the two places beside it, in proportion (values outside to the end they are beyond), and
    the places' weights are smoothed. Values are counted before any shuffle; what is smoothed has at most ``points`` rows a unit."""
    step = (high - low) / (points - 1)
    known = samples.where(F.col(x).isNotNull())
    moments = known.groupBy(unit).agg(F.count("*").alias("_n"), F.stddev_samp(x).alias("_std"))
    quarts = quantiles(samples, x, [0.25, 0.75], (unit,))
    width = F.coalesce(silverman(F.col("_n"), F.col("_std"), F.col("q1") - F.col("q0")), F.lit(0.0))
    scales = join_on(moments, quarts, [unit]).select(unit, "_n", F.greatest(width, F.lit(step)).alias("_h"))
    place = F.least(F.greatest((F.col(x) - low) / step, F.lit(0.0)), F.lit(float(points - 1)))
    left = F.floor(place)
    two = F.array(F.struct(left.alias("g"), (1 - (place - left)).alias("w")), F.struct((left + 1).alias("g"), (place - left).alias("w")))
    weights = known.select(unit, F.explode(two).alias("b")).where("b.w > 0").groupBy(unit, F.col("b.g").alias("g")).agg(F.sum("b.w").alias("w"))
    each = join_on(weights, scales, [unit]).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("at") - F.col("g")) * step / F.col("_h")
    kernel = F.col("w") * F.exp(-z * z / 2) / (F.col("_h") * math.sqrt(2 * math.pi) * F.col("_n"))
    return each.groupBy(unit, (F.lit(low) + F.col("at") * step).alias("at")).agg(F.sum(kernel).alias("density"))
