"""Screen minutes from traffic by Monte Carlo, with draws keyed by seed, sample, service and index.

A minute of a service takes a random amount of traffic. The minutes of a traffic value are the number of cumulative sums of
such minutes that lie below it. All samples are one job: ``sample`` is a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.functions.scalars import clamped_normal, uniform
from cubespark.operators.ordered import join_on, running_total, running_totals
from cubespark.sources.store import cut_lineage

# Megabytes an hour by service.
MB_PER_HOUR = {
    "TWITCH": 800, "ORANGE_TV": 900, "WEB_GAMES": 100, "WEB_WEATHER": 5, "TWITTER": 100, "APPLE_MUSIC": 150, "WEB_ADS": 30,
    "SOUNDCLOUD": 150, "WIKIPEDIA": 15, "WEB_FOOD": 50, "YOUTUBE": 800, "PINTEREST": 200, "WEB_CLOTHES": 60, "WEB_ADULT": 800,
    "DAILYMOTION": 800, "INSTAGRAM": 200, "CLASH_OF_CLANS": 100, "POKEMON_GO": 60, "WEB_FINANCE": 50, "FACEBOOK_LIVE": 800,
    "EA_GAMES": 100, "APPLE_VIDEO": 900, "LINKEDIN": 100, "SNAPCHAT": 200, "DEEZER": 150, "NETFLIX": 900, "FACEBOOK": 200,
    "MOLOTOV": 900, "WEB_E_COMMERCE": 60, "FORTNITE": 100, "PERISCOPE": 800, "SPOTIFY": 150, "WEB_STREAMING": 800, "YAHOO": 100,
}
SPREAD = 0.5


#: What draws a minute's traffic: of its mean, the seed and the columns that key the draw.
Sampler = Callable[..., Column]


def normal(mean: Column, seed: str, *key: Column) -> Column:
    return clamped_normal(mean, SPREAD * mean, seed, *key)


def by_inverse(quantile: Callable[[Column, Column], Column]) -> Sampler:
    """A sampler of any distribution, from its inverse: of a uniform number and the mean."""
    return lambda mean, seed, *key: quantile(uniform(seed, *key), mean)


#: Draws that are summed up in one go; a group's blocks are spread over tasks.
BLOCK = 1 << 16


def ticks(groups: DataFrame, seed: str, sampler: Sampler = normal) -> DataFrame:
    """(sample, city, service, i, cum): running sums of minutes, past 1.2 times each group's largest traffic; stored.

    ``groups``: (sample, city, service, mb_per_hour, most). The number of draws has slack; if a group's sum still falls short, all get
    twice as many, until none does. Extra ticks change nothing, as only those below a traffic value count. Draws are summed up in
    blocks, from the sum of the blocks before.
    """
    mean = F.col("mb_per_hour") / 60
    key = ["sample", "city", "service"]
    own = Window.partitionBy(*key, "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    factor = 1
    while True:
        n = (F.ceil(1.5 * F.col("most") / mean) + 64) * factor
        blocks = groups.withColumn("n", n).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
        i = F.sequence(F.col("block") * BLOCK + 1, F.least("n", (F.col("block") + 1) * BLOCK))
        draws = blocks.repartition(*key, "block").withColumn("i", F.explode(i))
        draw = sampler(mean, seed, F.col("sample"), F.col("city"), F.col("service"), F.col("i"))
        sums = cut_lineage(draws.withColumn("draw", draw).select(*key, "block", "i", "most", F.sum("draw").over(own).alias("part")))
        each = sums.groupBy(*key, "block").agg(F.max("part").alias("whole"), F.first("most").alias("most"))
        if each.groupBy(*key).agg(F.sum("whole").alias("c"), F.first("most").alias("m")).where("c < 1.2 * m").isEmpty():
            each = each.select(*key, "block", F.coalesce(F.sum("whole").over(before), F.lit(0.0)).alias("before"))
            return sums.join(each, [*key, "block"]).select(*key, "i", (F.col("before") + F.col("part")).alias("cum"))
        factor *= 2


def count_below(values: DataFrame, marks: DataFrame, by: list[str], value: str, mark: str) -> DataFrame:
    """Add ``below``: how many marks of the group are less than the value. A null value has a null count.

    Equal values are one, however many rows have them, so that a value of most rows (a zero) is no task of its own. The distinct ones
    and the marks are laid end to end in one running count over ranges, at ties the values first, and joined back."""
    x = F.col(value).cast("double")
    distinct = values.where(x.isNotNull()).select(*by, x.alias("_x")).distinct().withColumn("_kind", F.lit(0))
    ends = marks.select(*by, F.col(mark).cast("double").alias("_x")).withColumn("_kind", F.lit(1))
    both = running_total(distinct.unionByName(ends), by, ["_x", "_kind"], F.col("_kind").cast("long"), "below")
    counted = both.where("_kind = 0").drop("_kind")
    return join_on(values.withColumn("_x", x), counted, [*by, "_x"], "left").drop("_x")


def counts_below(values: DataFrame, marks: DataFrame, by: list[str], value: str, mark: str, n_samples: int) -> DataFrame:
    """Add ``below``: for each sample, how many of its marks in the group are less than the value, as an array; all null for a null value.

    ``marks`` has a column ``sample``, ``values`` has none: a value stands once for all samples, so only the marks are there once for each."""
    x = F.col(value).cast("double")
    distinct = values.where(x.isNotNull()).select(*by, x.alias("_x")).distinct().withColumns({"_kind": F.lit(0), "_sample": F.lit(None).cast("int")})
    ends = marks.select(*by, F.col(mark).cast("double").alias("_x"), F.lit(1).alias("_kind"), F.col("sample").cast("int").alias("_sample"))
    amounts = {f"_below{k}": F.when(F.col("_sample") == k, 1).otherwise(0).cast("long") for k in range(n_samples)}
    both = running_totals(distinct.unionByName(ends), by, ["_x", "_kind"], amounts)
    counted = both.where("_kind = 0").select(*by, "_x", F.array(*amounts).alias("below"))
    return join_on(values.withColumn("_x", x), counted, [*by, "_x"], "left").drop("_x")


def with_samples(cube: DataFrame, n: int) -> DataFrame:
    return cube.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def screen_time_individual(cube: DataFrame, rates: DataFrame, n_samples: int, seed: str = "0", sampler: Sampler = normal) -> DataFrame:
    """The cube in minutes, once per sample, from minute-by-minute draws. Services without a rate drop out."""
    known = cube.join(F.broadcast(rates), "service")  # a literal table
    most = known.groupBy("city", "service", "mb_per_hour").agg(F.max("value").alias("most"))
    marks = ticks(with_samples(most, n_samples), seed, sampler)
    out = with_samples(counts_below(known.drop("mb_per_hour"), marks, ["city", "service"], "value", "cum", n_samples), n_samples)
    return out.withColumn("value", F.get("below", F.col("sample")).cast("double")).drop("below")


def screen_time_mean(cube: DataFrame, rates: DataFrame, n_samples: int, seed: str = "0", sampler: Sampler = normal) -> DataFrame:
    """The cube in minutes, once per sample, from one draw of the rate per sample and service, the same for all cities."""
    mean = F.col("mb_per_hour") / 60
    drawn = with_samples(rates, n_samples).withColumn("_rate", sampler(mean, seed, F.col("sample"), F.col("service")))
    joined = cube.join(F.broadcast(drawn.drop("mb_per_hour")), "service")  # samples times a literal table
    return joined.withColumn("value", F.try_divide("value", "_rate")).drop("_rate")


TECHNIQUES = {"individual": screen_time_individual, "mean": screen_time_mean}


def screen_time_samples(cube: DataFrame, rates: DataFrame, n_samples: int, technique: str, seed: str = "0", sampler: Sampler = normal) -> DataFrame:
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown sampling technique {technique}")
    return TECHNIQUES[technique](cube, rates, n_samples, seed, sampler)


def sample_times(probability: DataFrame, unit: str, n: int, seed: str = "0") -> DataFrame:
    """(unit, i, slot): n draws with replacement from each unit's distribution p over slots, by its cumulative sums."""
    w = Window.partitionBy(unit).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    cdf = probability.withColumn("_cum", F.sum("p").over(w))
    slots = cdf.groupBy(unit).agg(F.array_sort(F.collect_list("slot")).alias("_slots"))  # one entry per slot of the day
    draws = probability.select(unit).distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("u", uniform(seed, F.col(unit), F.col("i")))
    found = count_below(draws, cdf.select(unit, "_cum"), [unit], "u", "_cum").join(slots, unit)
    last = F.size("_slots")
    return found.select(unit, "i", F.element_at("_slots", F.least(F.col("below").cast("int") + 1, last)).alias("slot"))


def alias_tables(probability: DataFrame, unit: str) -> DataFrame:
    """(unit, table): an array of (slot, keep, other) for each unit's weights p over slots, of which a draw takes an entry at random, then
    its slot with the probability ``keep``, else the other.

    With weights scaled to a mean of one, light slots lack what heavy ones have too much of. Both are laid end to end in the order of
    slots: a light slot is filled up by the heavy one whose span of excess holds the place where its own lack begins; a heavy one that
    has given more than its excess is filled up by the next. So sums up to each slot are all that the table needs."""
    mean = F.avg("p").over(Window.partitionBy(unit))
    upto = Window.partitionBy(unit, "_heavy").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rows = probability.where("p > 0").withColumn("_w", F.col("p") / mean).withColumn("_heavy", F.col("_w") > 1)
    rows = rows.withColumn("_gap", F.abs(F.col("_w") - 1)).withColumn("_sum", F.sum("_gap").over(upto))
    entry = F.struct("slot", F.col("_w").alias("w"), F.col("_gap").alias("gap"), F.col("_sum").alias("sum"))
    sides = [F.array_sort(F.collect_list(F.when(side, entry))).alias(name) for name, side in (("_light", ~F.col("_heavy")), ("_high", F.col("_heavy")))]
    both = rows.groupBy(unit).agg(*sides)  # an entry per slot of the day

    def giver(lack: Column) -> Column:
        return F.get(F.filter("_high", lambda h: h["sum"] > lack), 0)["slot"]

    light = F.transform("_light", lambda x: F.struct(x["slot"].alias("slot"), x["w"].alias("keep"), F.coalesce(giver(x["sum"] - x["gap"]), x["slot"]).alias("other")))

    def given(h: Column, i: Column) -> Column:
        past = F.get(F.filter("_light", lambda x: x["sum"] >= h["sum"]), 0)["sum"]
        after = F.get(F.col("_high"), i + 1)["slot"]
        keep = F.when(after.isNull() | past.isNull(), 1.0).otherwise(1 - (past - h["sum"]))
        return F.struct(h["slot"].alias("slot"), keep.alias("keep"), F.coalesce(after, h["slot"]).alias("other"))

    return both.select(unit, F.array_sort(F.concat(light, F.transform("_high", given))).alias("table"))


def sample_times_alias(probability: DataFrame, unit: str, n: int, seed: str = "0") -> DataFrame:
    """(unit, i, slot): n draws with replacement from each unit's weights p over slots, two keyed numbers each. The draws are made beside
    the unit's table and never shuffled."""
    draws = alias_tables(probability, unit).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    size = F.size("table")
    at = F.least(F.floor(uniform(seed, F.col(unit), F.col("i")) * size), size - 1).cast("int")
    taken = draws.select(unit, "i", F.get("table", at).alias("e"), uniform(seed, F.col(unit), F.col("i"), word=1).alias("u"))
    return taken.select(unit, "i", F.when(F.col("u") < F.col("e.keep"), F.col("e.slot")).otherwise(F.col("e.other")).alias("slot"))
