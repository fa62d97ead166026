"""Quality rules against plain loops, the ratio included."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import xxhash

from cubespark.llm.quality_rules import BUCKETS, MICRO, SIGMAS, keep_good, quality_flags
from tests.llm.conftest import prose


def base(text: str | None) -> tuple:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def hashed(*parts: str | int) -> int:
    """Spark's xxhash64 of strings and ints, one after the other."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p.to_bytes(4, "little")
        h = xxhash.xxh64_intdigest(data, h) if isinstance(p, str) else _int_hash(p, h)
    return h if h < 1 << 63 else h - (1 << 64)


def _int_hash(x: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)


def grams(text: str | None) -> list[int]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    one = [hashed(x) % BUCKETS for x in w]
    return one + [hashed(*w[i : i + 2], 2) % BUCKETS for i in range(len(w))]


def brute(rows: list[tuple], trusted: set[int]) -> list[tuple]:
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, text, _ in rows:
        for g in grams(text):
            raw[g] += 1
            good[g] += d in trusted
    share = [np.log((x + 0.5) / (x.sum() + 0.5 * BUCKETS)) for x in (good, raw)]
    ratio = np.rint((share[0] - share[1]) * MICRO).astype(int) if good.sum() else np.zeros(BUCKETS, int)
    scores = [sum(int(ratio[g]) for g in grams(t)) // len(grams(t)) if grams(t) else None for _, t, _ in rows]
    own = [s for s, (d, _, _) in zip(scores, rows, strict=True) if d in trusted and s is not None]
    least = round(np.mean(own) - SIGMAS * np.std(own)) if own else None
    out = []
    for (d, text, _), s in zip(rows, scores, strict=True):
        b = base(text)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        out.append((d, *b, failed, not failed and (least is None or s >= least), s))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_equals_loops(spark, make_docs, awkward):
    rng = random.Random(3)
    rows = [(100 + i, prose(rng, 60, 200).replace("w1", "\n"), "s") for i in range(60)]
    rows += [(300 + i, " ".join(f"J{rng.randrange(9999)}***" for _ in range(50)), "s") for i in range(6)]
    rows += [(400, "a b c d e f\n" * 9 + "\n\n x", "s"), (401, prose(rng, 30) + " <| & |>", "s"), *awkward]
    trusted = {100 + i for i in range(40)}
    labels = spark.createDataFrame([(d, 1, 0) for d in trusted] + [(300, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    want = brute(rows, trusted)
    assert got(quality_flags(make_docs(rows), labels)) == want
    assert not any(r[7] for r in want if r[0] is not None and 300 <= r[0] < 306)
    docs = make_docs(rows)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if r[7])


def test_without_labels_or_rows(spark, make_docs, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert got(quality_flags(make_docs(awkward), labels)) == brute(awkward, set())
    assert quality_flags(make_docs(awkward).limit(0), labels).count() == 0


def test_trusted_ids_joined_by_merge_give_the_same(spark, make_docs):
    rng = random.Random(24)
    df = make_docs([(i, prose(rng, 60, 300 if i % 2 else 3000), "s") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one, many = (sorted(map(tuple, quality_flags(df, labels, small=n).collect())) for n in (1 << 20, 0))
    assert one == many
