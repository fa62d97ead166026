"""How quality filters interact: what each removes in every order of applying them, and its Shapley value, by counting lattice paths.

A document's state is the set of filters that it fails, as the bits of a number. The states of a run of filters are the
subsets applied so far, a lattice of 2 ** k nodes; an order is a path through it from the empty to the full set, and the edge that adds
filter f to the set S removes the documents that fail f and nothing in S. So the corpus is read once, into counts by failed set; each
count is added to the edges that it belongs to. Going forward the lattice counts the paths that reach a node, going backward those that
leave it: forward times backward is the number of orders through an edge, by which its removals are weighted and summed into the filter's
Shapley value. The steps of single orders are read from the same edges.

Rows are counted before any shuffle, so a source that holds a third of them is no task of its own. Copies are found by 128 bits of their
text's hash, and only texts that several rows have are joined back; a join of which adaptive execution splits a hot text.

Cases: a null text is empty. A null source is the part ''. Rows that repeat an id are documents of their own and none is a copy of the
other; a null id is smaller than no other, and is not a copy. A document with several labels counts as good or toxic if one of them says
so; one without a label is neither. Parts without rows don't exist: an empty table gives an empty result. Very long texts are worked on
whole. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import stash, words

#: The letters of the five filters, in the order of their bits.
FILTERS = "ABCDE"
#: Beyond this many filters the lattice and the orders are too many to list.
MOST = 7
MEASURES = ("n", "good", "toxic")


def failures(text: Column, w: Column) -> dict[str, Column]:
    """The conditions of the filters that look at one text, which has the words ``w``."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(w) < 200,
        "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by the set of filters that they fail. ``docs``: (doc_id, text, source); ``labels``:
    (doc_id, quality, toxic)."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words(text).alias("w"))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failures(F.col("text"), F.col("w")).items()]
    rows = rows.select("doc_id", "part", sum(bits, F.lit(0)).alias("failed"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"))
    # Hashes alone are read for the copies; the texts' words aren't worked out for that.
    hashed = docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"))
    copied = hashed.groupBy("h", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("_most")).where("least < _most").drop("_most")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    rows = rows.join(copied.hint("merge"), ["h", "h2"], "left")
    rows = rows.select("doc_id", "part", (F.col("failed") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sums = [F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]]
    return rows.join(marks.hint("merge"), "doc_id", "left").groupBy("part", "failed").agg(*sums)


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """For each subset of k filters, how many orders reach it from the empty set, and how many leave it for the full set."""
    full = (1 << k) - 1
    reach, leave = [1] + [0] * full, [0] * full + [1]
    for s in range(1, full + 1):
        reach[s] = sum(reach[s ^ (1 << f)] for f in range(k) if s >> f & 1)
    for s in range(full - 1, -1, -1):
        leave[s] = sum(leave[s | (1 << f)] for f in range(k) if not s >> f & 1)
    return reach, leave


def edges(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through it) of the edges of the lattice."""
    reach, leave = path_counts(k)
    return [(s, f, reach[s] * leave[s | (1 << f)]) for s in range(1 << k) for f in range(k) if not s >> f & 1]


def _literal(rows: Sequence[tuple], *names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])


def _sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def edge_removals(sets: DataFrame, k: int) -> DataFrame:
    """(part, state, filter, orders, removed, good_lost, toxic_lost): a row for each part and edge of the lattice, zeros too."""
    every = sets.select("part", "failed", *MEASURES, F.explode(_literal(edges(k), "state", "filter", "orders")).alias("e"))
    on = (F.col("failed").bitwiseAND(F.col("e.state")) == 0) & (F.getbit("failed", F.col("e.filter")) == 1)
    sums = [_sum_where(on, F.col(m)).alias(name) for m, name in zip(MEASURES, ("removed", "good_lost", "toxic_lost"), strict=True)]
    return every.groupBy("part", "e.state", "e.filter", "e.orders").agg(*sums)


def shapley(removals: DataFrame) -> DataFrame:
    """(part, filter, shapley): removals summed over all orders; over their number, it is the Shapley value."""
    return removals.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))


def order_steps(removals: DataFrame, sets: DataFrame, filters: str = FILTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """A row for each part, order and step, as audit() gives them, from the edges that the orders take."""
    orders = orders if orders is not None else ["".join(p) for p in permutations(filters)]
    place = {f: i for i, f in enumerate(filters)}
    taken: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in orders:
        state = 0
        for step, f in enumerate(order, 1):
            taken.setdefault((state, place[f]), []).append((order, step))
            state |= 1 << place[f]
    uses = [(s, f, order, step) for (s, f), v in taken.items() for order, step in v]
    uses = removals.sparkSession.createDataFrame(uses, "state int, filter int, filter_order string, step int")
    steps = removals.join(F.broadcast(uses), ["state", "filter"])  # of MOST filters, some 35,000 rows
    steps = steps.select("part", "filter", "removed", "good_lost", "toxic_lost", "filter_order", "step")
    # Of a filter: what fails it, what fails it alone; of a part: all.
    n = F.col("n")
    each = []
    for i in range(len(filters)):
        fails, alone = F.getbit("failed", F.lit(i)) == 1, F.col("failed") == 1 << i
        each.append(F.struct(F.lit(i).alias("filter"), _sum_where(fails, n).alias("fails"), _sum_where(alone, n).alias("unique_fails")))
    totals = sets.groupBy("part").agg(F.sum(n).alias("all"), F.array(*each).alias("each")).select("part", "all", F.explode("each").alias("t"))
    totals = totals.select("part", "all", "t.*").join(shapley(removals).hint("merge"), ["part", "filter"])
    # Each order's steps are few, so their running sum is made in an array.
    return _with_kept(steps.join(totals.hint("merge"), ["part", "filter"]))


def _with_kept(steps: DataFrame) -> DataFrame:
    own = ["removed", "good_lost", "toxic_lost", "fails", "unique_fails", "shapley"]
    orders = steps.groupBy("part", "filter_order", "all").agg(F.array_sort(F.collect_list(F.struct("step", *own))).alias("s"))
    each = orders.select("part", "filter_order", "all", "s", F.posexplode("s").alias("i", "x"))
    gone = F.aggregate(F.slice("s", F.lit(1), F.col("i") + 1), F.lit(0).cast("long"), lambda a, x: a + x["removed"])
    return each.select(
        "part", "filter_order", "x.step", (F.col("all") - gone).alias("kept"), "x.removed", (F.col("x.fails") - F.col("x.removed")).alias("redundant"),
        "x.unique_fails", "x.good_lost", "x.toxic_lost", "x.shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, orders: Sequence[str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, each of the
    ``orders`` of the letters FILTERS (all of them by default) and each of its steps."""
    sets = failed_sets(docs, labels)
    return audit_sets(sets, orders=orders)


def audit_sets(sets: DataFrame, filters: str = FILTERS, orders: Sequence[str] | None = None) -> DataFrame:
    """The same from failed_sets() of any filters: (part, failed, n, good, toxic)."""
    if len(filters) > MOST:
        raise ValueError(f"{len(filters)} filters have too many orders to list; at most {MOST}")
    sets = stash(sets)
    return order_steps(edge_removals(sets, len(filters)), sets, filters, orders)
