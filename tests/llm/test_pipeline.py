"""The pipeline, stage by stage, against the brute-force versions of its operators, and as a whole."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
from cubespark.llm.secret_scan import MASK, find_secrets
from tests.llm import test_near_dedup, test_quality_rules
from tests.llm.conftest import prose
from tests.llm.test_mixing import water

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]


def documents() -> list[tuple]:
    rng = random.Random(12)
    texts = [t for _ in range(5) for t in test_near_dedup.family(rng, 12, 6)] + [prose(rng, rng.choice([20, 60, 300])) for _ in range(90)]
    texts += [" ".join(f"J{rng.randrange(9999)}***" for _ in range(40)) for _ in range(6)] + ["w1 " * 50, "too short", "", None]
    texts += [prose(rng, 30) + f" password = {'k' * 14}{i} " + prose(rng, 20) for i in range(6)] + [prose(rng, 9000)]
    texts.append(texts[-1])
    rng.shuffle(texts)
    return [(i, t, "en", rng.choice(["s0", "s0", "s0", "s1", None, "s3"]), len(t) if t else 0) for i, t in enumerate(texts)]


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows = documents()
    trusted = {r[0] for r in rows if r[1] and len(r[1].split()) >= 20 and "***" not in r[1] and r[0] % 2}
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, 1, 0) for d in trusted], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    seen, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/out-{n}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
        assert n == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    plain = [(r[0], r[1], r[3]) for r in rows]
    good = {r[0] for r in test_quality_rules.brute(plain, trusted) if r[7]}
    assert sorted(r.doc_id for r in seen["quality_rules"]) == sorted(good)
    one = {r[0] for r in test_near_dedup.brute([p for p in plain if p[0] in good], 5) if r[3]}
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted(one)
    source = {r[0]: r[1] for r in rows}
    for r in seen["secret_scan"]:
        want, at = "", 0
        for _, a, b in find_secrets(source[r.doc_id]):
            want, at = want + source[r.doc_id][at:a] + MASK, b
        want += source[r.doc_id][at:]
        assert r.text == want and r.n_chars == len(want)
    assert sum(MASK in r.text for r in seen["secret_scan"]) == 6

    size = {r.doc_id: len(r.text.split()) for r in seen["secret_scan"]}
    per, taken = defaultdict(int), defaultdict(int)
    for r in seen["secret_scan"]:
        per[r.source] += size[r.doc_id]
    copies = Counter(r.doc_id for r in seen["source_mixing"])
    assert copies.keys() <= size.keys() and max(copies.values()) <= 3
    for r in seen["source_mixing"]:
        taken[r.source] += size[r.doc_id]
    largest = {s: max(size[r.doc_id] for r in seen["secret_scan"] if r.source == s) for s in per}
    assert all(abs(taken[s] - t) < largest[s] for s, t in water(per).items())

    packed, bins = defaultdict(int), defaultdict(int)
    for r in seen["best_fit_packing"]:
        packed[r.doc_id] += r.length
        bins[r.bin, r.capacity] += r.length
    assert dict(packed) == {d: size[d] * c for d, c in copies.items()} and all(n <= c for (_, c), n in bins.items())
    assert Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(str, seen["best_fit_packing"]))


def test_every_stage_takes_an_empty_table_and_awkward_rows(spark, tmp_path, make_docs, awkward):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], awkward):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n == 0 if not rows else n > 0, name
            if name != "best_fit_packing":
                assert out.columns == docs.columns
