"""Best-fit packing of documents into training sequences of several permitted lengths.

A document of n words is cut into pieces of at most the largest length; every word lies in exactly one piece. Pieces are
dealt by hash into tasks and packed in blocks of BLOCK pieces, so a task holds one block whatever its share of the rows.
Within a block, pieces go in decreasing length, each into the open bin whose room it fits best. If none has room, a bin of
the least cost per filled token is opened: the cost of a permitted length over what the piece and the shorter pieces still
to come can fill of it. The lengths are optimised jointly: the rule runs once with all lengths on offer and once with each
subset of the shortest or longest ones that can hold the block's longest piece; the packing of the least total cost
wins. At the end each bin shrinks to the shortest permitted length that holds its contents.

Cases: a document without words has one row, in no bin. Repeated rows and repeated or null ids are packed as rows of their
own. A very long text is a number of pieces, dealt like those of others. Ties go to the piece, bin or length that comes first. An empty
table gives an empty result. Other columns, whatever their names, don't matter. Results depend on the rows alone: a task packs its
rows in the order of their hash, id, piece and length.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import n_words, small_batches, stash, with_long

LENGTHS = (512, 1024, 2048, 4096)
BLOCK = 8192
_PER_TASK = 8 * BLOCK
_SCHEMA = "doc_id string, piece int, start long, length long, bin string, capacity long, offset long"


def sequence_cost(length: int) -> float:
    """The cost of a sequence: its tokens, attention that grows with its square, and a fixed part."""
    return length * (1 + length / 16384) + 16


def _fit(sizes: list[int], lengths: Sequence[int], cost: dict[int, float]) -> tuple[list[int], list[list[int]]]:
    """Best fit of decreasing ``sizes``: the capacity and the items of each bin."""
    to_come = sum(sizes)
    capacity, items = [], []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i, size in enumerate(sizes):
        to_come -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left = min((n for n in lengths if n >= size), key=lambda n: (cost[n] / min(n, size + to_come), n))
            b = len(items)
            capacity.append(left)
            items.append([])
        items[b].append(i)
        if left > size:
            insort(room, (left - size, b))
    return capacity, items


def pack_block(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost=sequence_cost) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) of each of ``sizes``, none above the largest length."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [sizes[i] for i in order]
    lengths = sorted(lengths)
    price = {n: cost(n) for n in lengths}
    offers = {tuple(lengths[k:]) for k in range(len(lengths))} | {tuple(lengths[:k]) for k in range(1, len(lengths) + 1)}
    best = None
    for offer in sorted(offers):
        if falling and offer[-1] < falling[0]:
            continue
        items = _fit(falling, offer, price)[1]
        fills = [sum(falling[i] for i in b) for b in items]
        capacity = [min(n for n in lengths if n >= fill) for fill in fills]
        total = sum(price[n] for n in capacity)
        if best is None or total < best[0]:
            best = (total, capacity, items)
    out: list = [None] * len(sizes)
    for b, (capacity, items) in enumerate(zip(*best[1:], strict=True)):
        offset = 0
        for i in items:
            out[order[i]] = (b, capacity, offset)
            offset += falling[i]
    return out


def _packer(lengths: Sequence[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, block, held = TaskContext.get().partitionId(), 0, []

        def packed() -> pd.DataFrame:
            placed = pack_block([int(p[3]) for p in held], lengths)
            rows = [(*p, f"{task}-{block}-{b}", c, o) for p, (b, c, o) in zip(held, placed, strict=True)]
            return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "bin", "capacity", "offset"])

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                held.append((row[0], *map(int, row[1:])))
                if len(held) == BLOCK:
                    yield packed()
                    block, held = block + 1, []
        if held:
            yield packed()

    return run


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, size: Column | None = None) -> DataFrame:
    """One row per piece of the rows of ``docs`` (doc_id, text): where it starts, and its bin, capacity and offset there.

    ``size`` is the column expression of a document's length; words by default. A tokenizer's count may take its place.
    """
    small_batches(docs.sparkSession)
    lengths = tuple(sorted(lengths))
    size = n_words(F.col("text")) if size is None else size
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("n"), F.xxhash64("doc_id", "text").alias("h")))
    most = lengths[-1]
    last = F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)).cast("int")
    pieces = sized.where("n > 0").select("doc_id", "n", "h", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    pieces = pieces.select("doc_id", "h", "piece", start.alias("start"), F.least(F.lit(most), F.col("n") - start).alias("length"))
    count = sized.agg(F.sum(F.ceil(F.col("n") / most))).first()[0] or 0
    order = F.xxhash64("h", "piece")
    dealt = pieces.repartition(max(1, math.ceil(count / _PER_TASK)), order).sortWithinPartitions(order, "doc_id", "piece", "length")
    keyed = dealt.select(F.col("doc_id").cast("string"), "piece", "start", "length")
    packed = with_long(keyed.mapInPandas(_packer(lengths), _SCHEMA), "doc_id")
    nothing = F.lit(None)
    empty = sized.where("n = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"),
        nothing.cast("string").alias("bin"), nothing.cast("long").alias("capacity"), nothing.cast("long").alias("offset"),
    )
    return packed.unionByName(empty)
