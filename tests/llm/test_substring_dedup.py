"""Repeated passages against all pairs of paragraphs."""

from __future__ import annotations

import os
import random

from cubespark.llm import linking
from cubespark.llm.common import stash
from cubespark.llm import substring_dedup
from cubespark.llm.substring_dedup import BANDS, MIN_WORDS, ROWS, drop_repeats, repeated_passages, tune_bands
from tests.llm.conftest import prose


def brute(rows: list[tuple]) -> set:
    found = []
    for d, text, _ in rows:
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            w = line.lower().split(" ")
            w = [x for x in w if x]
            if len(w) >= MIN_WORDS:
                found.append((d, k, at, at + len(line), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
            at += len(line) + 1
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][4], found[j][4]
            if 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(found)):
        groups.setdefault(root(i), []).append(found[i])
    out = set()
    for g in groups.values():
        if len(g) > 1:
            first = min(g, key=lambda x: x[:2])
            out |= {(*x[:4], len(g), x[:2] != first[:2], first[0]) for x in g}
    return out


def test_equals_all_pairs(make_docs):
    rng = random.Random(8)
    shared = [prose(rng, 60) for _ in range(5)]
    rows = []
    for i in range(80):
        lines = [prose(rng, rng.choice([3, 20, 60])) for _ in range(4)]
        passage = rng.choice(shared).split()
        for _ in range(rng.randrange(3)):
            passage[rng.randrange(60)] = "edit"
        lines.insert(rng.randrange(4), " ".join(passage))
        rows.append((i, "\n".join(lines), "s"))
    got = repeated_passages(make_docs(rows)).collect()
    lines = {(d, k): line for d, t, _ in rows for k, line in enumerate(t.split("\n"))}
    whole = {(r.doc_id, r.paragraph, r.start, r.end, r.cluster_size, r.removed, r.kept_doc_id) for r in got if r.end - r.start == len(lines[r.doc_id, r.paragraph])}
    assert whole == brute(rows)


def test_passage_inside_longer_paragraphs(make_docs):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 50)} é {passage} {prose(rng, 50)}", "s") for i in range(4)] + [(9, prose(rng, 200), "s")]
    got = repeated_passages(make_docs(rows)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3}
    text = {d: t for d, t, _ in rows}
    assert all(text[r.doc_id][r.start : r.end] in passage for r in got)
    left = {r.doc_id: r.text for r in drop_repeats(make_docs(rows)).collect()}
    assert left[0] == text[0] and left[9] == text[9] and all(len(left[i].split()) <= 161 - 9 for i in (1, 2, 3))


def test_a_copied_paragraph_shares_a_passage_with_one_other_document(make_docs):
    rng = random.Random(10)
    passage = prose(rng, 100)
    copied = f"{prose(rng, 60)} {passage} {prose(rng, 60)}"
    rows = [(0, copied, "s"), (1, copied, "s"), (2, f"{prose(rng, 60)} {passage} {prose(rng, 60)}", "s")]
    left = {r.doc_id: r.text for r in drop_repeats(make_docs(rows)).collect()}
    assert left[0] == copied and not left[1].strip() and len(left[2].split()) <= 220 - 40


def test_whole_passages_over_any_lines(make_docs):
    rng = random.Random(11)
    rows, want = [], set()
    for k in range(30):
        passage = prose(rng, rng.choice([31, 51, 60, 100]), 10**6).split()
        for i in (2 * k, 2 * k + 1):
            step = rng.choice([7, 12, 200])  # wrapped into lines that are too short for paragraphs, or not at all
            inner = "\n".join(" ".join(passage[at : at + step]) for at in range(0, len(passage), step))
            text = f"{prose(rng, 60, 10**6)} {inner} {prose(rng, 60, 10**6)}"
            rows.append((i, text, "s"))
            want.add((i, text.index(inner), text.index(inner) + len(inner), 2, i % 2 == 1, 2 * k))
    got = [(r.doc_id, r.start, r.end, r.cluster_size, r.removed, r.kept_doc_id) for r in repeated_passages(make_docs(rows)).collect()]
    assert sorted(got) == sorted(want)
    left = {r.doc_id: r.text for r in drop_repeats(make_docs(rows)).collect()}
    assert all(left[d] == t if d % 2 == 0 else len(left[d].split()) == 120 for d, t, _ in rows)


def test_awkward_rows_and_bands(make_docs, awkward):
    got = repeated_passages(make_docs(awkward)).collect()
    assert {r.doc_id for r in got} <= {7, 8}
    assert repeated_passages(make_docs(awkward).limit(0)).count() == 0
    docs = make_docs(awkward)
    assert drop_repeats(docs).columns == docs.columns and drop_repeats(docs).count() == len(awkward)
    assert (BANDS, ROWS) == tune_bands(0.8) and (1 - 0.8**ROWS) ** BANDS <= 1e-4


def test_short_lines_and_clashing_names(make_docs):
    rng = random.Random(18)
    lines = ["one", "two three", "a b c d e f"]
    rows = [(i, "\n".join([*lines, prose(rng, 4), prose(rng, 20)]), "s") for i in range(3)]
    for least, n in ((1, 3), (3, 1), (0, 3)):
        got = repeated_passages(make_docs(rows), least).collect()
        assert sorted((r.doc_id, r.paragraph) for r in got) == [(d, k) for d in range(3) for k in range(3 - n, 3)]
    clash = make_docs(rows).withColumnsRenamed({"key": "_doc", "size": "_spans", "label": "_new", "id": "_row"})
    left = drop_repeats(clash, 1)
    assert left.columns == clash.columns and all(("one" in r.text.split()) == (r.doc_id == 0) for r in left.collect())


def brute_passages(rows: list[tuple], run: int = 15) -> dict:
    """By document, the words that a common run of ``run`` words or more covers, as removed, kept or both."""
    first, docs = {}, {}
    words = {d: t.lower().split() for d, t, _ in rows}
    for d, w in words.items():
        for i in range(len(w) - run + 1):
            g = tuple(w[i : i + run])
            first.setdefault(g, (d, i))
            docs.setdefault(g, set()).add(d)
    out = {}
    for d, w in words.items():
        for i in range(len(w) - run + 1):
            g = tuple(w[i : i + run])
            if len(docs[g]) > 1:
                out.setdefault((d, first[g] != (d, i)), set()).update(range(i, i + run))
    return out


def test_passages_equal_brute_force(make_docs):
    """Long common runs in texts of one line each, which are no near-equal paragraphs."""
    rng = random.Random(19)
    pool = [prose(rng, n, 10**6) for n in (31, 40, 51, 80)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(90, 160), 10**6)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(pool), prose(rng, rng.randrange(90, 160), 10**6)]
        rows.append((i, " ".join(parts), "s"))
    text = {d: t for d, t, _ in rows}
    got = {}
    for r in repeated_passages(make_docs(rows)).collect():
        before = len(text[r.doc_id][: r.start].split())
        got.setdefault((r.doc_id, r.removed), set()).update(range(before, before + len(text[r.doc_id][r.start : r.end].split())))
    assert got == brute_passages(rows)


def test_texts_of_null_and_repeated_ids_are_cut_by_themselves(make_docs):
    rng = random.Random(21)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (7, f"{c} end", "s"), (7, a, "s"), (7, a, "s")]
    left = sorted(((r.doc_id, r.text) for r in drop_repeats(make_docs(rows)).collect()), key=str)
    assert left == sorted([(1, a), (None, ""), (None, b), (7, f"{c} end"), (7, ""), (7, "")], key=str)


def test_components_of_many_edges_give_the_same(make_docs):
    rng = random.Random(22)
    base = [prose(rng, 60).split() for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(base[i % 6])
        words[rng.randrange(60)] = "edit"
        rows.append((i, f"{' '.join(words)}\n{prose(rng, 30)}", "s"))
    df = make_docs(rows)
    one, many = (sorted(map(tuple, repeated_passages(df, small=n).collect()), key=str) for n in (1 << 12, 0))
    assert one == many and len(one) >= 60


def test_a_common_passage_makes_few_pairs(make_docs, monkeypatch):
    """Paragraphs that share a passage meet by their rare shingles, and a large neighbourhood doesn't meet itself."""
    rng = random.Random(24)
    common = prose(rng, 60, 10**6)
    texts = [f"{common} {prose(rng, own, 10**6)}" for own in [2, 8, 11, 14, 20, 30, 40, 60] * 30]
    for _ in range(60):
        w = common.split()
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(60)] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    pairs, verified = [], linking._verified

    def counted(found, *more):
        pairs.append(stash(found))
        return verified(pairs[-1], *more)

    monkeypatch.setattr(linking, "_verified", counted)
    got = repeated_passages(make_docs(rows)).collect()
    whole = {(r.doc_id, r.paragraph, r.start, r.end, r.cluster_size, r.removed, r.kept_doc_id) for r in got if r.end - r.start == len(texts[r.doc_id])}
    assert whole == brute(rows)
    assert len(pairs) == 2 and pairs[1].count() < 2 * len(rows)  # stars, and pairs across neighbourhoods


def test_large_tables_go_before_the_result_is_read(make_docs, monkeypatch):
    """Keys and seeds of all texts, and the sets, are no longer held when the result's own shuffles are; it can still be read twice."""
    rng = random.Random(25)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 50)} {passage} {prose(rng, 50)}\n{passage}", "s") for i in range(6)]
    made = []

    def kept(df):
        made.append((set(df.columns), stash(df)))
        made[-1] += ({os.path.dirname(f.removeprefix("file://")) for f in made[-1][1].inputFiles()},)
        return made[-1][1]

    monkeypatch.setattr(substring_dedup, "stash", kept)
    df = repeated_passages(make_docs(rows))
    large, rest = ([f for columns, _, at in made for f in at if bool({"keys", "members"} & columns) == big] for big in (True, False))
    assert len(large) == 2 and not any(map(os.path.exists, large)) and all(map(os.path.exists, rest))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect())) and df.count() >= 12
