"""Similarity links between sets, and their connected components, without expanding groups into all pairs.

Sets are known by a 64-bit id (the hash of the whole set), so that equal sets are one vertex from the start. An operator
gives each vertex a number of 64-bit keys; vertices that share a key are candidates. Every candidate pair is linked, or
compared on the full sets, or its sketches are too far apart:

1. star: each bucket's members against its smallest id, one pair per member. The pairs whose sketches are near make
   neighbourhoods (their components); those that are verified make the first labels.
2. within a neighbourhood of several labels: the members outside its largest label against all others, in blocks of sets
   that meet in one task and give only the verified links. A neighbourhood of one label, such as a plain group of near
   copies, costs nothing here.
3. across neighbourhoods: the members of the buckets that hold several, by the rarest of their shingles. Two sets at the threshold
   share one of the rarest few of each (a prefix filter), so that a common passage, which would pair all that hold it, is no key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.llm.common import mix, small_batches, stash

SKETCH_WORDS = 3
SKETCH_SLOTS = 28 * SKETCH_WORDS
#: Sets, and members of sets, on either side of a block comparison.
BLOCK = 1024
BLOCK_MEMBERS = 1 << 20
#: Edges that one task joins into components.
SMALL = 1 << 12
#: Slots in which shingles are counted: by their first bits, since those that are known by 48 bits have zeros as their last.
WEIGHT_BITS = 20
WEIGHTS = 1 << WEIGHT_BITS
_EVEN = 0x5555555555555555


def _hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minhashes(shingles: np.ndarray, k: int) -> np.ndarray:
    """``k`` min-wise hash values (uint32) of a set of 64-bit hashes. The set must not be empty."""
    a, b = _hash_family(k)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):  # blocks that stay in the processor's cache
        np.minimum(out, (low[at : at + 2048, None] * a + b).min(axis=0), out=out)
    return out


def minhash_rows(shingles: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """A row of ``k`` min-wise hash values for each of the sets that lie one after another, from the places in ``begin``."""
    a, b = _hash_family(k)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    end = np.append(begin[1:], len(low))
    out, at = np.empty((len(begin), k), np.uint32), 0
    while at < len(begin):  # as many sets as have 4096 members, or one
        to = max(at + 1, int(np.searchsorted(end, begin[at] + 4096, "right")))
        if to == at + 1:
            out[at] = minhashes(shingles[begin[at] : end[at]], k)
        else:
            out[at:to] = np.minimum.reduceat(low[begin[at] : end[to - 1], None] * a + b, begin[at:to] - begin[at], axis=0)
        at = to
    return out


def symbols(minhash: np.ndarray, bits: int = 8) -> np.ndarray:
    """b-bit symbols of min-wise hash values."""
    return ((minhash * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.uint64)


def sketch_rows(minhash: np.ndarray) -> np.ndarray:
    """Two bits of each of the first SKETCH_SLOTS values of every row, packed into SKETCH_WORDS signed longs."""
    two = ((minhash[:, :SKETCH_SLOTS] * np.uint32(0x85EBCA6B)) >> np.uint32(30)).astype(np.uint64)
    two = two.reshape(len(minhash), SKETCH_WORDS, 28)
    return (two << (np.arange(28, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def set_ids(shingles: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of sets that lie one after another, and their sizes."""
    size = np.diff(np.append(begin, len(shingles)))
    place = np.arange(1, len(shingles) + 1) - np.repeat(begin, size)
    h = np.add.reduceat(mix(shingles ^ mix(place.astype(np.uint64))), begin)
    return mix(h ^ size.astype(np.uint64)).view(np.int64), size


def _near(a: str, b: str, threshold: float) -> Column:
    """Whether the sketches and set sizes of two sides allow the threshold: 4.7 standard deviations of slack."""
    miss = (1 - threshold) * 0.75
    most = int(SKETCH_SLOTS * miss + 4.7 * (SKETCH_SLOTS * miss * (1 - miss)) ** 0.5) + 1
    apart = F.lit(0)
    for i in range(SKETCH_WORDS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        apart += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN)))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (apart <= most) & (small >= F.floor(large * threshold))


def shared_buckets(keys: DataFrame) -> DataFrame:
    """Of rows (id, key), those whose key several ids share, with the bucket's smallest id as ``center``; stored.

    A key's ends are combined before the shuffle, and the join back can be split where a key is hot."""
    ends = keys.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("_last"))
    return stash(keys.join(ends.where("center < _last").drop("_last").hint("merge"), "key"))


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of all edges of a task."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = up = parent[up]
            v = up
        return v

    for batch in batches:
        for hi, lo in zip(batch["hi"].tolist(), batch["lo"].tolist(), strict=True):
            x, y = root(hi), root(lo)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame([(v, root(v)) for v in list(parent)], columns=["id", "label"], dtype="int64")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, label) for every end of ``edges`` (a, b): label is the smallest id that can be reached. At most ``small`` edges are one
    task.

    More edges go through rounds, which alternate the large-star and small-star steps of Kiveris et al. (2014) until the edges are
    stars. Each round is a few grouped joins over stored edges; the number of rounds grows with the logarithm of the longest path.
    """
    both = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    stars, before = stash(both), None
    if stars.count() <= small:
        return stash(stars.repartition(1).mapInPandas(_union_find, "id long, label long"))
    while True:
        ways = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(low, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                )
            ).alias("e")
        )
        stars = stash(near.select("e.*").where("hi <> lo").distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("hi").alias("id"), F.col("lo").alias("label")).unionByName(
                stars.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct()
            )
        before = now


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sets have a Jaccard similarity of at least ``threshold``, by whole numbers."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("_b"))
    # Neither side has a size bound, so neither is ever broadcast, however small it is here.
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    union = F.size("_a") + F.size("_b") - F.col("_both")
    percent = round(threshold * 100)
    return both.where(F.col("_both") * 100 >= union * percent).select("a", "b")


def _block_links(threshold: float):
    """Links of the sets of side 1 with those of side 0 in the same cell; rows come sorted by cell and side."""
    percent = round(threshold * 100)

    def tables(held: list) -> Iterator[tuple]:
        at = 0
        while at < len(held):
            end, words = at, 0
            while end < len(held) and (end == at or (words + len(held[end][2])) * (end + 1 - at) <= 1 << 24):
                words += len(held[end][2])
                end += 1
            part = held[at:end]
            vocabulary, place = np.unique(np.concatenate([m for _, _, m in part]), return_inverse=True)
            sizes = np.array([len(m) for _, _, m in part])
            has = np.zeros((len(vocabulary), len(part)), bool)
            has[place, np.repeat(np.arange(len(part)), sizes)] = True
            yield vocabulary, has, sizes, np.array([i for i, _, _ in part]), np.array([g for _, g, _ in part])
            at = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, built = None, [], None
        for batch in batches:
            out = []
            rows = zip(*(batch[c] for c in ("hood", "mb", "gb", "side", "id", "label", "members")), strict=True)
            for hood, mb, gb, side, vertex, label, members in rows:
                if (hood, mb, gb) != cell:
                    cell, held, built = (hood, mb, gb), [], None
                if side == 0:
                    held.append((vertex, label, np.asarray(members)))
                    continue
                built = list(tables(held)) if built is None else built
                members = np.asarray(members)
                for vocabulary, has, sizes, ids, labels in built:
                    at = np.minimum(np.searchsorted(vocabulary, members), len(vocabulary) - 1)
                    both = has[at[vocabulary[at] == members]].sum(axis=0)
                    linked = (both * 100 >= percent * (sizes + len(members) - both)) & (labels != label)
                    out += [(vertex, other) for other in ids[linked]]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _links_within(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between different labels of one neighbourhood."""
    labels = placed.groupBy("hood", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    mixed = (
        labels.groupBy("hood")
        .agg(F.max(F.struct("size", "label", "n")).alias("top"), F.count("*").alias("labels"), F.sum("size").alias("all"), F.sum("n").alias("n"))
        .where("labels > 1")
        .select(
            "hood",
            F.col("top.label").alias("major"),
            F.greatest(F.ceil((F.col("all") - F.col("top.size")) / BLOCK), F.ceil((F.col("n") - F.col("top.n")) / BLOCK_MEMBERS)).alias("m_blocks"),
            F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("n") / BLOCK_MEMBERS)).alias("g_blocks"),
        )
    )
    members = placed.select("id", "label", "hood").join(mixed, "hood").join(sets, "id")
    own = F.xxhash64("id")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    cells = ["hood", "mb", "gb", "side", "id", "label", "members"]
    minor = members.where("label <> major").select("*", F.lit(0).alias("side"), F.pmod(own, "m_blocks").alias("mb"), every("g_blocks").alias("gb"))
    whole = members.select("*", F.lit(1).alias("side"), F.pmod(own, "g_blocks").alias("gb"), every("m_blocks").alias("mb"))
    rows = minor.select(*cells).unionByName(whole.select(*cells)).repartition("hood", "mb", "gb")
    return rows.sortWithinPartitions("hood", "mb", "gb", "side", "id").mapInPandas(_block_links(threshold), "a long, b long")


def _first_tokens(weight: np.ndarray, percent: int):
    """The rarest shingles of each set, of which two sets at the threshold share one, with their places in the set's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, places = [], [], []
            for row, members in enumerate(batch["members"]):
                token = members.values.to_numpy()
                rare = weight[token.view(np.uint64) >> np.uint64(64 - WEIGHT_BITS)]
                order = np.lexsort((token, rare))[: len(token) - -(-len(token) * percent // 100) + 1]
                order, place = order[rare[order] > 0], np.flatnonzero(rare[order] > 0)
                rows.append(np.full(len(order), row))
                tokens.append(token[order])
                places.append(place)
            if rows:
                at = pa.array(np.concatenate(rows))
                kept = [batch[c].take(at) for c in _PLACED]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places))], [*_PLACED, "token", "place"])

    return run


_PLACED = ("id", "hood", "n", *[f"s{i}" for i in range(SKETCH_WORDS)])


def _with_major(keyed: DataFrame) -> DataFrame:
    """The rows whose token stands in several neighbourhoods, with the one that has most of them as ``major``; stored."""
    sizes = keyed.groupBy("token", "hood").agg(F.count("*").alias("size"))
    tokens = sizes.groupBy("token").agg(F.max(F.struct("size", "hood")).alias("top"), F.count("*").alias("hoods")).where("hoods > 1")
    return stash(keyed.join(tokens.select("token", F.col("top.hood").alias("major")).hint("merge"), "token"))


def _links_across(buckets: DataFrame, placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between members of different neighbourhoods that meet in a bucket.

    Shingles are put in one order: first those of one neighbourhood only, then by the number of sets that hold them. Of two sets at
    the threshold, each has one of the other's among its first n - threshold * n + 1, so only those are keys. The numbers are counted
    by hash in WEIGHTS slots, which is all that comes to the driver; any order is right, and one by rarity makes the fewest pairs.
    Of a key's members those outside its largest neighbourhood meet all of other neighbourhoods, so that a large one doesn't meet itself."""
    percent = round(threshold * 100)
    rows = buckets.select("key", "id").join(placed.select("id", "hood").hint("merge"), "id")
    hoods = rows.groupBy("key").agg(F.min("hood").alias("_low"), F.max("hood").alias("_high")).where("_low < _high").select("key")
    mixed = rows.join(hoods.hint("merge"), "key", "left_semi").select("id").distinct()
    placed = placed.select(*[F.col(c).cast("long").alias(c) for c in _PLACED])
    own = stash(mixed.join(placed.hint("merge"), "id").join(sets.hint("merge"), "id"))
    slots = own.select("hood", F.explode("members").alias("token")).groupBy(F.shiftrightunsigned("token", 64 - WEIGHT_BITS).alias("slot"))
    slots = slots.agg(F.count("*").alias("df"), F.min("hood").alias("_low"), F.max("hood").alias("_high")).where("_low < _high")
    counted = slots.select(F.col("slot").cast("int"), F.least("df", F.lit(2**31 - 1)).cast("int").alias("df")).toArrow()  # toPandas() makes a Python object of each row
    weight = np.zeros(WEIGHTS, np.int32)  # 0: in one neighbourhood only
    weight[counted["slot"].to_numpy()] = counted["df"].to_numpy()
    schema = ", ".join(f"{c} long" for c in (*_PLACED, "token", "place"))
    keyed = _with_major(stash(own.select(*_PLACED, "members").mapInArrow(_first_tokens(weight, percent), schema)))
    x, y = keyed.where("hood <> major").alias("x"), keyed.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.hood") != F.col("y.hood")) & ((F.col("y.hood") == F.col("y.major")) | (F.col("x.id") < F.col("y.id")))
    # At the first shingle that two sets share, what is left of the shorter rest must be enough for the threshold.
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = rest * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    pairs = x.join(y.hint("merge"), apart & enough & _near("x", "y", threshold)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    return _verified(pairs.distinct(), sets, threshold)


def linked_components(buckets: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float, small: int = SMALL) -> DataFrame:
    """(id, label) of the vertices in components of two or more.

    ``buckets`` as shared_buckets() gives them; ``sketches`` (id, n, s0..); ``sets`` (id, members array<long>), both for
    every id in buckets at least, and stored. ``small``: edges that one task joins into components; beyond, they go through rounds.
    """
    small_batches(buckets.sparkSession)
    stars = buckets.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    near = stash(
        stars.join(sketches.alias("x"), F.col("a") == F.col("x.id"))
        .join(sketches.alias("y"), F.col("b") == F.col("y.id"))
        .where(_near("x", "y", threshold))
        .select("a", "b")
    )
    edges = stash(_verified(near, sets, threshold))
    labels, hoods = components(edges, small), components(near, small).withColumnRenamed("label", "hood")
    placed = sketches.join(hoods, "id", "left").join(labels, "id", "left")
    placed = stash(placed.withColumns({"hood": F.coalesce("hood", "id"), "label": F.coalesce("label", "id")}))
    more = stash(_links_within(placed, sets, threshold).unionByName(_links_across(buckets, placed, sets, threshold)))
    return labels if more.isEmpty() else components(edges.unionByName(more), small)
