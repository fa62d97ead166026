"""Packing: every word once, no bin too full, bins as small as they can be."""

from __future__ import annotations

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from cubespark.llm.packing import LENGTHS, pack, pack_block, sequence_cost
from tests.llm.conftest import prose


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_blocks(sizes):
    lengths = (8, 16, 32, 64)
    placed = pack_block(sizes, lengths)
    bins = defaultdict(list)
    for size, (b, capacity, offset) in zip(sizes, placed, strict=True):
        bins[b].append((offset, size, capacity))
    for items in bins.values():
        at = 0
        for offset, size, capacity in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity and capacity == min(n for n in lengths if n >= at)
    cost = sum(sequence_cost(items[0][2]) for items in bins.values())
    assert cost <= sum(sequence_cost(min(n for n in lengths if n >= s)) for s in sizes) + 1e-9


def test_documents(make_docs, awkward):
    rng = random.Random(4)
    rows = awkward + [(100 + i, prose(rng, rng.choice([5, 100, 700, 5000])), "s") for i in range(120)]
    got = pack(make_docs(rows)).collect()
    words, bins = defaultdict(int), defaultdict(int)
    for r in got:
        words[r.doc_id] += r.length
        if r.bin is None:
            assert r.length == 0
        else:
            assert r.capacity in LENGTHS and 0 < r.length <= r.offset + r.length <= r.capacity and r.start % LENGTHS[-1] == 0
            bins[r.bin, r.capacity] += r.length
    want = defaultdict(int)
    for d, text, _ in rows:
        want[d] += len((text or "").replace(" ", "x").replace(" ", "x").split())
    assert dict(words) == dict(want) and all(n <= c for (_, c), n in bins.items())
    assert sum(bins.values()) / sum(c for _, c in bins) > 0.9
    again = pack(make_docs(rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert pack(make_docs(rows).limit(0)).count() == 0


def plain(sizes: list[int], lengths: tuple[int, ...]) -> tuple[float, list[int]]:
    """The least cost, and the sorted capacities, by the rule in plain loops over all bins."""
    best = None
    for offer in [lengths[k:] for k in range(len(lengths))] + [lengths[:k] for k in range(1, len(lengths))]:
        if sizes and max(sizes) > offer[-1]:
            continue
        bins, falling = [], sorted(sizes, reverse=True)  # [room, fill]
        for i, size in enumerate(falling):
            fitting = [b for b in bins if b[0] >= size]
            if fitting:
                chosen = min(fitting, key=lambda b: b[0])
            else:
                to_come = sum(falling[i + 1 :])
                room = min((n for n in offer if n >= size), key=lambda n: (sequence_cost(n) / min(n, size + to_come), n))
                bins.append(chosen := [room, 0])
            chosen[0] -= size
            chosen[1] += size
        capacity = sorted(min(n for n in lengths if n >= fill) for _, fill in bins)
        cost = sum(map(sequence_cost, capacity))
        if best is None or cost < best[0] - 1e-9:
            best = (cost, capacity)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_blocks_equal_plain_loops(sizes):
    lengths = (8, 16, 32, 64)
    placed = pack_block(sizes, lengths)
    capacity = {b: c for b, c, _ in placed}
    assert sum(map(sequence_cost, capacity.values())) == plain(sizes, lengths)[0]
