"""The filter audit against walking every order over the documents, and against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest

from cubespark.llm.filter_audit import FILTERS, audit, audit_sets, edges, path_counts
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(rows: list[tuple]) -> list[tuple]:
    """(part, doc_id, letters that it fails)."""
    ids = defaultdict(list)
    for d, text, _ in rows:
        if d is not None:
            ids[text or ""].append(d)
    out = []
    for d, text, source in rows:
        t, w = text or "", WORD.findall(text or "")
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > min(ids[t]))
        out.append((source or "", d, "".join(f for f, bad in zip(FILTERS, tests, strict=True) if bad)))
    return out


def brute(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    docs, out = failed(rows), []
    for part in {p for p, _, _ in docs}:
        own = [(d, bad) for p, d, bad in docs if p == part]
        shapley, steps = Counter(), []
        for order in map("".join, permutations(FILTERS)):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                redundant = sum(f in bad for _, bad in own) - len(gone)
                steps.append((f, part, order, step, len(left), len(gone), redundant, sum(bad == f for _, bad in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*s[1:], shapley[s[0]]) for s in steps]
    return sorted(out)


def check(spark, rows, labels, make_docs):
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in audit(make_docs(rows), df).collect())
    assert got == brute(rows, labels)


def test_equals_walking_all_orders(spark, make_docs):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        text = prose(rng, rng.choice([5, 150, 250]), rng.choice([20, 3000]))
        rows.append((i, text + rng.choice(["", " $", " ABCDEFGHIJ" * 9]), rng.choice(["a", "b", None])))
    rows += [(100 + i, rows[i][1], "b") for i in range(0, 40, 3)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    check(spark, rows, labels, make_docs)


def test_awkward_rows(spark, make_docs, awkward):
    check(spark, [*awkward, (None, None, ""), (1, "", "a")], [(5, 1, 0), (5, 1, 1), (9, 1, 1)], make_docs)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(make_docs([]), empty).count() == 0
    assert audit(make_docs(awkward[:3]), empty, orders=["EDCBA"]).count() == 10


def test_paths_through_the_lattice():
    for k in range(1, 7):
        reach, leave = path_counts(k)
        assert reach[-1] == leave[0] == factorial(k)
        assert reach == [factorial(s.bit_count()) for s in range(1 << k)] and leave == [factorial(k - s.bit_count()) for s in range(1 << k)]
        by_filter = Counter()
        for _, f, n in edges(k):
            by_filter[f] += n
        assert set(by_filter.values()) == {factorial(k)}  # every order takes each filter once


def test_other_filters_and_the_shapley_sum(spark):
    sets = spark.createDataFrame([("p", s, 10 + s, s % 3, 0) for s in range(8)], "part string, failed int, n long, good long, toxic long")
    got = audit_sets(sets, "xyz").collect()
    assert len(got) == 6 * 3
    shapley = {r.filter_order[r.step - 1]: r.shapley for r in got}
    assert sum(shapley.values()) == 6 * sum(10 + s for s in range(1, 8))  # all that any filter removes, for each order
    with pytest.raises(ValueError, match="too many"):
        audit_sets(sets, "abcdefgh")
