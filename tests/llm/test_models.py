"""Language identification and the quality classifier: held-out accuracy, and the parts against plain formulas."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cubespark.llm.common import held_out
from cubespark.llm.language_id import RIVAL, TOP, UNKNOWN, Filter, fit, identify, ngrams
from cubespark.llm.quality_classifier import DIM, RANK, Machine, classify, train, vector
from tests.llm.conftest import prose

SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "ké ka ko ki ku".split(), "cc": "ša še ši šo šu".split()}


def speech(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_language_accuracy_and_awkward_rows(spark):
    rng = random.Random(6)
    rows = [(i, speech(rng, lang := rng.choice(list(SYLLABLES)), 30), lang) for i in range(300)]
    extra = [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (None, "ba be", "aa"), (903, "zzz qqq", "cc"), (903, "zzz qqq", "cc")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = identify(docs).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {d: lang for d, _, lang in rows}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 40 and all(truth[r.doc_id] == r.lang_pred and 0 <= r.score <= 1 for r in tested)
    assert all(r.lang_pred == UNKNOWN and r.score == 0 for r in got if r.doc_id in (900, 901, 902))
    assert identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", held_out(docs.doc_id).cast("string")).where("lang = 'x'")).collect()} == set()


def test_filter_has_no_false_negatives_and_takes_many_languages():
    rng = np.random.default_rng(1)
    grams = {f"l{i:03}": rng.integers(0, 1 << 63, 50, dtype=np.uint64) for i in range(130)}
    model = Filter.build(grams)
    assert model.masks.shape[0] == 3 and model.false_rate.max() < 1e-6
    from cubespark.llm.language_id import _slots

    for i, lang in enumerate(model.languages):
        found = np.bitwise_and.reduce([model.masks[i // 64][s] for s in _slots(grams[lang])])
        assert ((found >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert len(ngrams("12 34")) == 0 and len(ngrams("Éa")) == 3


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = Machine(0.3, rng.normal(0, 0.1, DIM), rng.normal(0, 0.1, (DIM, RANK)), np.zeros(12), np.ones(12))
    text = "some words and SOME other words, 12 of them!"
    index, value = vector(text)
    value = m.standardise(value, slice(len(index) - 13, len(index) - 1))
    z = 0.3 + m.weight[index] @ value
    z += sum(m.factor[index[i]] @ m.factor[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
    assert abs(m.score(text) - 1 / (1 + np.exp(-z))) < 1e-6
    assert train([], [], np.array([])).score(None) == 0.5


def test_quality_held_out(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        text = prose(rng, 40, 300)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), 1))
        labels.append((i, int(good)))
    rows += [(900, None, 1), (901, "", 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    known = spark.createDataFrame([*labels, (0, 0), (None, 1), (5000, 1)], "doc_id long, quality int")
    got = classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 80 and sum(truth[r.doc_id] == r.predicted for r in tested) / len(tested) > 0.98
    assert {r.score for r in classify(docs, known.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), known).count() == 0


def plain_grams(text: str | None) -> list[str]:
    """The n-grams of 3 and 4 characters; other characters than letters are one blank."""
    said = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not said.strip():
        return []
    said = " " + "".join(c for c, before in zip(said, "x" + said, strict=False) if c != " " or before != " ") + " "
    return [said[i : i + n] for n in (3, 4) for i in range(len(said) - n + 1)]


def test_languages_equal_plain_sets(spark, make_docs, awkward):
    """Fit and predictions against sets of n-grams in plain Python: the filter's false positives are too few to matter here."""
    rng = random.Random(15)
    rows = [(i, speech(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 40)) + rng.choice(["", " 12!", "\n"]), rng.choice(["aa", "bb"])) for i in range(120)]
    rows += [(200 + i, t, "cc") for i, (_, t, _) in enumerate(awkward)]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    counts: dict[str, Counter] = defaultdict(Counter)
    held = {r.doc_id: r.h for r in docs.select("doc_id", held_out(docs.doc_id).alias("h")).collect()}
    for d, text, lang in rows:
        if not held[d]:
            counts[lang].update(plain_grams(text))
    counts = {k: Counter({g: n for g, n in c.items() if n > 1}) for k, c in counts.items()}
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    most: dict[str, float] = defaultdict(float)
    for s in share.values():
        for g, x in s.items():
            most[g] = max(most[g], x)
    own = {k: {g for g in s if s[g] >= RIVAL * most[g]} for k, s in share.items()}
    assert all(len(g) <= TOP for g in own.values())
    got = {r.doc_id: r for r in identify(docs).collect()}
    for d, text, _ in rows:
        grams = plain_grams(text)
        if not grams:
            assert (got[d].lang_pred, got[d].score) == (UNKNOWN, 0.0)
            continue
        hit = {k: sum(g in own[k] for g in grams) / len(grams) for k in sorted(own)}
        total = sum(hit.values())
        assert got[d].score == pytest.approx(max(hit.values()) / total if total else 1 / len(hit), abs=2e-3)
        best = max(hit.values())
        assert hit[got[d].lang_pred] >= best - 2e-3


def test_quality_of_awkward_rows_is_that_of_the_machine(spark, make_docs, awkward):
    from cubespark.llm.quality_classifier import score_documents

    rng = np.random.default_rng(3)
    m = Machine(0.1, rng.normal(0, 0.1, DIM).astype(np.float32), rng.normal(0, 0.1, (DIM, RANK)).astype(np.float32), np.zeros(12, np.float32), np.ones(12, np.float32))
    docs = make_docs(awkward).withColumnsRenamed({"label": "score", "key": "held_out", "size": "predicted"})
    got = score_documents(docs, m).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(d), round(m.score(t), 9)) for d, t, _ in awkward)


def test_training_equals_plain_loops():
    """Adam on the logistic loss, feature by feature and pair by pair, in one batch an epoch."""
    from cubespark.llm.quality_classifier import DECAY, EPOCHS, RATE, STATS

    rng = random.Random(20)
    texts = [prose(rng, 6, 12) if i % 2 else prose(rng, 5, 12).upper() + " !!" for i in range(24)]
    label = np.array([float(i % 2) for i in range(24)])
    made = [vector(t) for t in texts]
    got = train([i for i, _ in made], [v for _, v in made], label)

    stats = np.array([v[-STATS - 1 : -1] for _, v in made])
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    docs = []
    for index, value in made:
        x = value.astype(float)
        x[-STATS - 1 : -1] = np.clip((value[-STATS - 1 : -1] - mean) / scale, -4, 4) / 4
        docs.append(dict(zip(index.tolist(), x.tolist(), strict=True)))
    begin = np.random.default_rng(11).normal(0, 0.02, (DIM, RANK))
    used = sorted({i for d in docs for i in d})
    theta = {(i, f): (begin[i, f - 1] if f else 0.0) for i in used for f in range(RANK + 1)} | {"bias": 0.0}
    first, second = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    for step in range(1, EPOCHS + 1):
        grad = {k: (0.0 if k == "bias" else DECAY * v) for k, v in theta.items()}
        for d, y in zip(docs, label, strict=True):
            total = [sum(theta[i, f] * x for i, x in d.items()) for f in range(RANK + 1)]
            pair = sum(0.5 * (total[f] ** 2 - sum((theta[i, f] * x) ** 2 for i, x in d.items())) for f in range(1, RANK + 1))
            error = (1 / (1 + np.exp(-(theta["bias"] + total[0] + pair))) - y) / len(docs)
            grad["bias"] += error
            for i, x in d.items():
                grad[i, 0] += error * x
                for f in range(1, RANK + 1):
                    grad[i, f] += error * x * (total[f] - theta[i, f] * x)
        size = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, g in grad.items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
            theta[k] -= size * first[k] / (np.sqrt(second[k]) + 1e-8)
    assert got.bias == pytest.approx(theta["bias"], abs=1e-4)
    assert max(abs(got.weight[i] - theta[i, 0]) for i in used) < 1e-3
    assert np.mean([abs(got.factor[i, f - 1] - theta[i, f]) < 1e-3 for i in used for f in range(1, RANK + 1)]) > 0.99
