"""Near duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cubespark.llm import linking
from cubespark.llm.near_dedup import CHUNKS, SLOTS, drop_near_duplicates, near_duplicates, signature_keys
from tests.llm.conftest import prose


def brute(texts: list[tuple], width: int, percent: int = 80) -> list[tuple]:
    sets = []
    for _, text, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(texts):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _, _) in enumerate(texts):
        c = d if not sets[i] else least.get(root(i))
        out.append((d, len(sets[i]), c, c == d))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def family(rng: random.Random, n: int, edits: int) -> list[str]:
    base = prose(rng, 80).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
        out.append(" ".join(words))
    return out


def test_equals_all_pairs_on_families_of_near_copies(make_docs):
    rng = random.Random(1)
    texts = [t for _ in range(6) for t in family(rng, 25, 12)] + [prose(rng, 60) for _ in range(50)]
    rng.shuffle(texts)
    rows = [(i, t.upper() if i % 7 == 0 else t, "s") for i, t in enumerate(texts)]
    assert got(near_duplicates(make_docs(rows), 2)) == brute(rows, 2)
    assert got(near_duplicates(make_docs(rows), 5)) == brute(rows, 5)


def test_awkward_rows(make_docs, awkward):
    assert got(near_duplicates(make_docs(awkward), 2)) == brute(awkward, 2)
    assert near_duplicates(make_docs(awkward).limit(0), 2).count() == 0


def test_filter_keeps_columns_and_one_of_each_group(make_docs, awkward):
    docs = make_docs(awkward)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 7, 9, 9]


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
        b = a.copy()
        b[rng.choice(SLOTS, 2 * CHUNKS - 1, replace=False)] ^= np.uint32(0x5A5A5A5A)
        assert set(signature_keys(a)) & set(signature_keys(b))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_components_equal_union_find(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.id: r.label for r in linking.components(edges).collect()}
    assert found == {r.id: r.label for r in linking.components(edges, small=-1).collect()}
    reach = {x: {x} for p in pairs for x in p}
    for _ in range(len(reach)):
        for a, b in pairs:
            reach[a] = reach[b] = reach[a] | reach[b]
            for x in reach[a]:
                reach[x] = reach[a]
    assert found == {x: min(r) for x, r in reach.items() if len(r) > 1}


def test_near_copies_of_a_template_with_a_common_passage(make_docs):
    """Sets that share a long common passage are alike, but mostly not linked: they meet by their rare shingles."""
    rng = random.Random(16)
    common = prose(rng, 60)
    texts = [f"{prose(rng, own)} {common}" for own in [5, 8, 12, 14, 16, 20, 30, 60] * 12]
    for t in texts[::6]:
        w = t.split()
        w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    assert got(near_duplicates(make_docs(rows), 5)) == brute(rows, 5)


def test_filter_decides_by_document_not_by_id(make_docs):
    rng = random.Random(17)
    a, b, c = (prose(rng, 50) for _ in range(3))
    docs = make_docs([(1, a, "s"), (1, b, "s"), (2, b, "s"), (None, c, "s"), (None, c + " x", "s"), (None, a, "s"), (3, c, "s"), (3, c, "s")])
    kept = sorted((str(r.doc_id), r.text) for r in drop_near_duplicates(docs).collect())
    assert kept == sorted([("1", a), ("1", b), ("3", c), ("3", c)])
    clash = docs.withColumnsRenamed({"key": "_gone", "size": "_text", "label": "_row", "id": "text_id"})
    assert drop_near_duplicates(clash).columns == clash.columns and drop_near_duplicates(clash).count() == 4


def test_components_of_many_edges_give_the_same(make_docs):
    rng = random.Random(23)
    base = [prose(rng, 80).split() for _ in range(5)]
    rows = []
    for i in range(80):
        words = list(base[i % 5])
        for _ in range(rng.randrange(8)):
            words[rng.randrange(80)] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(words), "s"))
    df = make_docs(rows)
    one, many = (sorted(map(tuple, near_duplicates(df, shingle=2, small=n).collect())) for n in (1 << 12, 0))
    assert one == many and len({r[2] for r in one}) < 80
    kept = [sorted(r.doc_id for r in drop_near_duplicates(df, small=n).collect()) for n in (1 << 12, 0)]
    assert kept[0] == kept[1]
