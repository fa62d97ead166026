"""Source mixing: targets by plain water filling, and the properties of the rounding."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cubespark.llm.mixing import _settled, apply_mix, mix
from tests.llm.conftest import prose


def water(sizes: dict) -> dict:
    """Targets by sharing in turn."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_caps_and_closeness(make_docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([0, 3, 20, 50, 200])), rng.choice(["a", "a", "a", "b", "ä", None, "zz", "B"])) for i in range(800)]
    rows.append((900, "tiny", "c"))
    got = mix(make_docs(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, taken = water(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 200, source  # less than the largest document
    again = mix(make_docs(rows).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_levels_of_the_tree_keep_the_sum(make_docs, monkeypatch):
    from cubespark.llm import mixing

    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN", 2)
    rows = [(i, "w " * 10, "a" if i < 300 else "b") for i in range(500)]
    got = mix(make_docs(rows)).collect()
    assert len(got) == 500
    for source in ("a", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10


def test_awkward_rows(make_docs, awkward):
    got = mix(make_docs(awkward)).collect()
    assert len(got) == len(awkward) and all(r.taken == 0 for r in got if r.size == 0)
    assert len({r.taken for r in got if r.doc_id == 5}) == 1
    assert mix(make_docs(awkward).limit(0)).count() == 0
    docs = make_docs(awkward)
    out = apply_mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    clash = docs.withColumnsRenamed({"key": "_copies", "size": "_id", "label": "_copy", "id": "_row"}).withColumn("a.b", F.lit(1))
    assert apply_mix(clash).columns == clash.columns and apply_mix(clash).count() == out.count()


def test_rounding_is_unbiased_and_close_to_the_target():
    rng = random.Random(13)
    sizes = [max(1, int(rng.lognormvariate(4, 1))) for _ in range(60)]
    rows = [("s", 0, i, n, 1, 1, 0.3) for i, n in enumerate(sizes)]
    copies, wrong, runs = [0] * len(rows), [], 600
    for seed in range(runs):
        out = _settled(rows, seed, 0, True)
        assert all(r[7] and r[5] in (1, 2) for r in out)
        for r in out:
            copies[r[2]] += r[5] - 1
        wrong.append(abs(sum((r[5] - 1) * r[3] for r in out) - 0.3 * sum(sizes)))
    assert all(abs(c / runs - 0.3) < 4.5 * (0.3 * 0.7 / runs) ** 0.5 for c in copies)
    assert sorted(wrong)[runs // 2] <= 20 and sorted(wrong)[int(0.9 * runs)] <= 0.01 * sum(sizes)


def test_leaves_hand_on_their_smallest_documents_and_keep_the_words():
    rng = random.Random(14)
    rows = [("s", 0, i, rng.randrange(1, 3000), 1, 0, 0.4) for i in range(500)]
    out = _settled(rows, 0, 0, False)
    left = [r for r in out if not r[7]]
    assert len(left) == 8 and max(r[3] for r in left) <= sorted(r[3] for r in rows)[20]
    assert sum(r[3] * (r[5] + r[6]) for r in out) == pytest.approx(0.4 * sum(r[3] for r in rows))


def test_sources_come_near_their_targets_on_real_sizes(spark):
    """Every source within the size of its largest document, and nearly all within 2 %."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    off = [abs(r.taken - r.target) for r in sums]
    assert len(sums) == 20 and all(o < r.most for o, r in zip(off, sums, strict=True))
    assert sum(o <= 0.02 * r.target for o, r in zip(off, sums, strict=True)) >= 18
