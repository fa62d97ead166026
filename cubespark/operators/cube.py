"""Cube operators: cubes are long tables (city, tile, service, slot, value).

An absent row is a zero; a null is a missing value, which sums and means skip. So a mean over a dimension divides by the
number of its members, less the nulls, and not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.functions.scalars import cyclic_seconds, seconds_of
from cubespark.operators.ordered import join_on
from cubespark.sources.store import cut_lineage, is_stored


def filter_labels(cube: DataFrame, column: str, labels: list[str], strict: bool = False) -> DataFrame:
    """Rows of the listed labels; ``strict`` raises ValueError if one of them doesn't occur."""
    if strict:
        known = {r[0] for r in cube.where(F.col(column).isin(labels)).select(column).distinct().collect()}
        if missing := sorted(set(labels) - known):
            raise ValueError(f"{column} has no {missing}")
    return cube.where(F.col(column).isin(labels))


def drop_labels(matrix: DataFrame, labels: list[str], *columns: str) -> DataFrame:
    """A long matrix without the labels, on every named axis."""
    for column in columns:
        matrix = matrix.where(~F.col(column).isin(labels))
    return matrix


def labels_of(cube: DataFrame, *columns: str) -> DataFrame:
    """(axis, label): the distinct labels of each axis."""
    parts = [cube.select(F.lit(c).alias("axis"), F.col(c).cast("string").alias("label")).distinct() for c in columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def relabel(cube: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace the labels of an axis by mapping (label, new); labels without one drop out."""
    named = mapping.select(F.col("label").alias("_label"), F.col("new").alias("_new"))
    return cube.join(named, F.col(column) == F.col("_label")).withColumn(column, F.col("_new")).drop("_label", "_new")


def select_ordered(table: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """Rows of the labels, with their place in the list as ``pos``."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(column)).cast("int")
    return table.withColumn("pos", place - 1).where("pos >= 0")


def sum_over(cube: DataFrame, *keep: str, value: str = "value") -> DataFrame:
    return cube.groupBy(*keep).agg(F.sum(value).alias(value))


def mean_over(cube: DataFrame, over: str, *keep: str, members: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Mean over a dimension of which absent members count as zero. ``members`` has the dimension's labels (and any columns
    of ``keep`` within which they are counted); by default those of the cube."""
    members = (cube if members is None else members).select(over, *[k for k in keep if members is not None and k in members.columns]).distinct()
    by = [c for c in members.columns if c != over]
    count = members.groupBy(*by).agg(F.count("*").alias("_n"))
    sums = cube.groupBy(*keep).agg(F.sum(value).alias("_s"), F.count_if(F.col(value).isNull()).alias("_null"))
    joined = sums.join(count, by) if by else sums.crossJoin(F.broadcast(count))  # one row
    return joined.select(*keep, F.try_divide("_s", F.col("_n") - F.col("_null")).alias(value))


def share(table: DataFrame, *within: str, value: str = "value", name: str = "share") -> DataFrame:
    """Each value over the sum of its group; null where that is zero."""
    return table.withColumn(name, F.try_divide(value, F.sum(value).over(Window.partitionBy(*within))))


def dense(table: DataFrame, slots: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """A row for every group and slot; absent ones are zero. ``slots`` is the small table of slots."""
    grid = table.select(*by).distinct().crossJoin(F.broadcast(slots.select("slot").distinct()))
    return grid.join(table, [*by, "slot"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def cumulative(table: DataFrame, *by: str, value: str = "share", name: str = "cdf") -> DataFrame:
    """Running sum over slots; the table has to be dense."""
    w = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn(name, F.sum(value).over(w))


def first_by(table: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """One row per key, the first in a total order."""
    return table.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def ranked(table: DataFrame, label: str, value: str = "value", within: tuple[str, ...] = ()) -> DataFrame:
    """Rank from 1 by decreasing value; ties by label. For tables of labels, which are small."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(value), label)))


def top_and_bottom(table: DataFrame, label: str, k: int, value: str = "value") -> DataFrame:
    """The k best and, from the worst up, the k worst of a ranking: side, place, label and value."""
    r = ranked(table, label, value).withColumn("_n", F.count("*").over(Window.partitionBy()))
    top = r.where(F.col("rank") <= k).select(F.lit("top").alias("side"), F.col("rank").alias("place"), label, value)
    low = r.where(F.col("rank") > F.col("_n") - k)
    return top.unionByName(low.select(F.lit("bottom").alias("side"), (F.col("_n") - F.col("rank") + 1).cast("int").alias("place"), label, value))


def cyclic_slots(times: DataFrame, reference: str = "22:00:00", column: str = "time") -> DataFrame:
    """(time, slot): the place of each distinct clock time after the reference; earlier times are of the next day."""
    after = cyclic_seconds(seconds_of(F.col(column)), reference)
    order = Window.partitionBy().orderBy(after)  # one row per distinct clock time, at most 86400
    return times.select(column).distinct().withColumn("slot", (F.row_number().over(order) - 1).cast("int"))


def concat_cubes(*cubes: DataFrame, same_slots: bool = True) -> DataFrame:
    """Rows of all cubes; ``same_slots`` raises ValueError where their slots differ."""
    if same_slots:
        slots = [{r[0] for r in c.select("slot").distinct().collect()} for c in cubes]
        if any(s != slots[0] for s in slots):
            raise ValueError("the cubes have different slots")
    out = cubes[0]
    for cube in cubes[1:]:
        out = out.unionByName(cube)
    return out


def align(key: str, *tables: DataFrame) -> DataFrame:
    """Full outer join of tables with one row per key, column by column."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, key, "full_outer")
    return out


def max_abs_difference(a: DataFrame, b: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """The largest absolute difference of two cubes; a row that one of them lacks is zero there."""
    right = b.select(*by, F.col(value).alias("_b"))
    gap = F.abs(F.coalesce(value, F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return a.select(*by, value).join(right, list(by), "full_outer").agg(F.max(gap).alias("max_abs_diff"))


def column_stats(table: DataFrame, *columns: str) -> DataFrame:
    """(column, mean, std, mean_plus_std) with the sample standard deviation."""
    entries = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in columns]
    rows = table.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    return rows.withColumn("mean_plus_std", F.col("mean") + F.col("std"))


#: Classes of values in the first pass of quantiles(), for each power of two, and into how many each further pass divides one.
BINADE, FINER = 1024, 1 << 16


def quantiles(table: DataFrame, column: str, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact linear quantiles of the non-null values as q0, q1, ..., for each group; null for a group without any.

    By selection: values are counted in classes, first by their binary exponent and leading digits; only those in the class of a wanted
    rank are counted again, in FINER classes of its range, until it has one value. A double takes a second pass as a rule and five at
    most. Nothing is sorted, and counts are combined before they are shuffled, so no group is one task.

    The values are stored, unless ``table`` is as cut_lineage() returned it: all passes must read the same ones, and a sum of doubles
    differs in its last digits each time it is made, as its parts arrive in another order. A value that leaves its class so shifts the
    ranks or loses one. For the same reason, store a table first whose rows are compared with its own quantiles."""
    rows = table.select(*by, F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rows = rows if is_stored(table) else cut_lineage(rows)
    size = F.floor((F.log2(F.abs("_x")) + 1075) * BINADE) + 1
    first = F.when(F.col("_x") == 0, F.lit(0).cast("long")).otherwise(F.signum("_x").cast("long") * size)
    found = [F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    classes = rows.groupBy(*by, first.alias("_class")).agg(*found)
    upto = Window.partitionBy(*by).orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    classes = classes.select("*", F.sum("_n").over(upto).alias("_to"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    ranks = [f(F.lit(q) * (F.col("_all") - 1)).cast("long") for q in qs for f in (F.floor, F.ceil)]
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), r.alias("r")) for k, r in enumerate(ranks)])

    def hit(t: DataFrame) -> Column:
        return F.explode(F.filter("_ranks", lambda x: (x["r"] >= F.col("_to") - F.col("_n")) & (x["r"] < F.col("_to"))))

    kept = [*by, "_all", "_k", "_r", "_before", "_lo", "_hi"]
    wanted = classes.withColumn("_ranks", ranks).withColumn("_hit", hit(classes))
    wanted = wanted.select(*by, "_all", F.col("_hit.k").alias("_k"), F.col("_hit.r").alias("_r"), (F.col("_to") - F.col("_n")).alias("_before"), "_lo", "_hi")
    wanted = cut_lineage(wanted)  # two rows for each group and quantile
    while not (wide := wanted.where("_lo < _hi")).isEmpty():
        cells = wide.groupBy(*by).agg(F.collect_set(F.struct("_before", "_lo", "_hi")).alias("_cells"))
        inside = F.explode(F.filter("_cells", lambda c: F.col("_x").between(c["_lo"], c["_hi"])))
        each = join_on(rows, cells, list(by)).select(*by, "_x", inside.alias("_c")).select(*by, "_x", "_c.*")
        part = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * FINER), F.lit(FINER - 1))
        parts = each.groupBy(*by, "_before", part.alias("_class")).agg(*found)
        own = Window.partitionBy(*by, "_before").orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = parts.withColumn("_to", F.col("_before") + F.sum("_n").over(own))
        open_ = wide.groupBy(*by, "_all", "_before").agg(F.collect_set(F.struct(F.col("_k").alias("k"), F.col("_r").alias("r"))).alias("_ranks"))
        parts = join_on(parts, open_, [*by, "_before"]).withColumn("_hit", hit(parts))
        finer = parts.select(*by, "_all", F.col("_hit.k").alias("_k"), F.col("_hit.r").alias("_r"), (F.col("_to") - F.col("_n")).alias("_before"), "_lo", "_hi")
        wanted = cut_lineage(wanted.where("_lo = _hi").select(*kept).unionByName(finer.select(*kept)))
    value = [F.max(F.when(F.col("_k") == k, F.col("_lo"))) for k in range(2 * len(qs))]
    between = []
    for i, q in enumerate(qs):
        at = F.lit(q) * (F.max("_all") - 1)
        low, high = value[2 * i : 2 * i + 2]
        alone = (F.floor(at) == F.ceil(at)) | (low == high)  # between equal values there is no other, but rounding may make one
        between.append(F.when(alone, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"q{i}"))
    if not by:
        return wanted.agg(*between)  # a row of nulls if there is no value
    return join_on(table.select(*by).distinct(), wanted.groupBy(*by).agg(*between), list(by), "left")


def quantile_bands(table: DataFrame, a: tuple[str, float], b: tuple[str, float], inclusive: bool = True) -> DataFrame:
    """Rows whose first column is in its top band and whose second is in its bottom band, marked ``high_low``, or the other
    way round, ``low_high``. A band starts at the column's quantile; ``inclusive`` says whether it holds the edge."""
    (x, p), (y, q) = a, b
    table = cut_lineage(table)  # the edges are of these very values
    edges = quantiles(table, x, [p, 1 - p]).toDF("x1", "x0").crossJoin(F.broadcast(quantiles(table, y, [1 - q, q]).toDF("y1", "y0")))
    rows = table.crossJoin(F.broadcast(edges))  # one row

    def above(c: str, e: str) -> Column:
        return F.col(c) >= F.col(e) if inclusive else F.col(c) > F.col(e)

    def below(c: str, e: str) -> Column:
        return F.col(c) <= F.col(e) if inclusive else F.col(c) < F.col(e)

    band = F.when(above(x, "x1") & below(y, "y0"), "high_low").when(below(x, "x0") & above(y, "y1"), "low_high")
    return rows.withColumn("band", band).where("band is not null").drop("x0", "x1", "y0", "y1")


def unpivot(table: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return table.unpivot(ids, columns, name, value)


def pivot(table: DataFrame, row: str, column: str, labels: list[str], value: str) -> DataFrame:
    """Long to wide with a declared list of columns."""
    return table.groupBy(row).pivot(column, labels).agg(F.first(value))
