"""Ranked lexical search against scoring every pair of an item and a document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespark.llm import lexical_search as L
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    held = [(d, Counter(terms(t))) for d, t, *_ in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, all_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    word = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    items = [(i, " ".join(rng.choices(word, k=rng.choice([1, 4, 30])))) for i in range(40)]
    docs = [(i, " ".join(rng.choices(word, k=rng.choice([1, 5, 40, 300])))) for i in range(500)]
    docs += [(500 + i, f"{docs[i][1]} {items[i % 40][1]}") for i in range(200)] + [(1000 - i, docs[7][1]) for i in range(60)]  # copies: ties
    return [(d, t, "s") for d, t in docs], items


@pytest.mark.parametrize(("bucket", "block"), [(16, 1 << 18), (64, 100), (4096, 1 << 18)])
def test_equals_scoring_all_pairs(spark, make_docs, corpus, bucket, block):
    docs, items = corpus
    got = L.search(make_docs(docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"), block_terms=block, bucket=bucket)
    assert found(got) == brute(docs, items)
    assert found(L.search(make_docs(docs), spark.createDataFrame(items[:5], "item_id long, text string"), k=3)) == brute(docs, items[:5], 3)


def test_awkward_rows(spark, make_docs, awkward):
    docs = [*awkward, (11, "É-Ü Straße 日本 ONE_two", "s"), (12, "one\x00TWO", "s"), (None, "one two", "b")]
    items = [(1, "One two"), (1, "One two"), (2, None), (3, " -- "), (4, "absent"), (None, "É tail tail 日本"), (5, "w3 w4 w3")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    assert found(L.search(make_docs(docs), df)) == brute(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert L.search(make_docs([]), df).count() == L.search(make_docs(docs), none).count() == 0


def test_bounds_leave_few_vectors_to_score():
    """Random vectors in order of length: the k best equal sorting, and most vectors are never scored."""
    rng = np.random.default_rng(1)
    n, terms_, scored, total = 4096, 300, 0, 0
    weight = rng.integers(1, 9000, terms_)
    dense = np.where(rng.random((n, terms_)) < 0.05, weight * rng.integers(1, 900_000, (n, terms_)), 0) * (rng.pareto(2, n)[:, None] + 0.1)
    dense = dense.astype(np.int64)
    length = np.sqrt((dense.astype(float) ** 2).sum(axis=1))
    dense, length = dense[np.argsort(-length)], np.sort(length)[::-1]
    for _ in range(20):
        place = rng.choice(terms_, 8, replace=False)
        count, best = rng.integers(1, 3, 8), L.Best(20, 0)
        for at in range(0, n, 256):
            row, col = np.nonzero(dense[at : at + 256])
            bucket = L.Bucket(np.arange(at, at + 256), length[at : at + 256], np.bincount(row, minlength=256), col, dense[at : at + 256][row, col], terms_)
            scored += bucket.search(place, count, best)
        score = dense[:, place] @ count
        want = sorted(zip((-score).tolist(), range(n), strict=True))[:20]
        assert [(-int(s), int(d)) for s, d in zip(best.score, best.doc_id, strict=True)] == want
        total += n
    assert scored < 0.2 * total


def test_terms_are_split_as_the_expression_does():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB9 _-\x00\x7fé日\nZ{") for _ in range(rng.randrange(30))) for _ in range(300)]
    data = [t.encode() for t in texts]
    text, _, count, n = L.term_counts(b"".join(data), np.cumsum([0, *map(len, data)]))
    want = [Counter(terms(t)) for t in texts]
    assert n.tolist() == [sum(c.values()) for c in want]
    for i, c in enumerate(want):
        assert sorted(count[text == i].tolist()) == sorted(c.values())


def test_thresholds_come_from_the_longest_vectors(spark, make_docs, corpus):
    """However the vectors are dealt, results are the same."""
    docs, items = corpus
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = L.search(make_docs(docs), spark.createDataFrame(items, "item_id long, text string").where(F.col("item_id") < 10))
            assert found(got) == brute(docs, items[:10])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
