"""Quality rules: counts that reject plain junk, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Every word and every pair of neighbouring words falls into one of BUCKETS buckets by hash. Two multinomials over the
buckets are counted: over all raw documents, and over all trusted ones (labels.quality = 1). A document's score is the mean over its n-grams of log(trusted share / raw share), in millionths and
whole numbers, so that it is the same on every run. It is kept if its score is not more than SIGMAS standard deviations
below the mean score of the trusted documents. All of this is column expressions; the only thing that comes to the driver
is the table of BUCKETS ratios, which goes back as one literal. The trusted ids are broadcast if there are at most SMALL of them, and
joined by merge beyond that; the result is the same.

Cases: a null text is an empty one: zero counts, base_failed. Without trusted documents the ratio decides nothing. Each row
is judged by itself and whole, however long, so repeated rows and null or repeated ids change nothing (a repeated id is trusted if its
label is). An empty table gives an empty result. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import stash, words

BUCKETS = 1 << 14
#: Trusted ids that are broadcast: 16 MB or so.
SMALL = 1 << 20
SIGMAS = 5.0
MICRO = 1_000_000


def _buckets(w: Column, after: Column) -> tuple[Column, Column]:
    """The buckets of a word and of its pair with the next word (with nothing, after the last)."""
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"), F.pmod(F.xxhash64(w, after, F.lit(2)), F.lit(BUCKETS)).cast("int")


def ratio_table(docs: DataFrame, trusted_ids: DataFrame) -> np.ndarray:
    """The log ratio of each bucket's trusted and raw shares, in millionths; half an n-gram is added to every bucket."""
    marked = docs.join(trusted_ids.withColumn("_t", F.lit(1)), "doc_id", "left")
    split = marked.select(words(F.col("text")).alias("_w"), F.coalesce("_t", F.lit(0)).alias("_t"))
    # Words are exploded beside their successors, and hashed after that, as lambdas over arrays aren't compiled.
    pairs = F.arrays_zip("_w", F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))).alias("_v"))
    each = split.select(F.explode(pairs).alias("p"), "_t").select(F.array(*_buckets(F.col("p._w"), F.col("p._v"))).alias("b"), "_t")
    grams = each.select(F.explode("b").alias("b"), "_t")
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, n, t in grams.groupBy("b").agg(F.count("*"), F.sum("_t")).collect():  # BUCKETS rows at most
        raw[b], trusted[b] = n, t
    if not trusted.sum():
        return np.zeros(BUCKETS, np.int64)
    share = [np.log((x + 0.5) / (x.sum() + 0.5 * BUCKETS)) for x in (trusted, raw)]
    return np.rint((share[0] - share[1]) * MICRO).astype(np.int64)


def with_score(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Add _llr, the mean ratio in millionths, to rows that have their words in _w; null without words."""
    table = F.lit(ratios)

    def of(w: Column, i: Column) -> Column:
        one, two = _buckets(w, F.get(F.col("_w"), i + 1))
        return F.get(table, one) + F.get(table, two)

    total = F.aggregate(F.transform("_w", of), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("_llr", F.when(F.size("_w") > 0, F.floor(total / (2 * F.size("_w")))))


def least_score(docs: DataFrame, trusted_ids: DataFrame, ratios: np.ndarray) -> int | None:
    """The score under which documents are rejected, from the trusted documents' scores; None without any."""
    rows = docs.join(trusted_ids, "doc_id").select(words(F.col("text")).alias("_w"))
    d = F.col("_llr").cast("decimal(20,0)")
    n, s, q = with_score(rows, ratios).agg(F.count("_llr"), F.sum(d), F.sum(d * d)).first()
    if not n:
        return None
    mean = int(s) / n
    return round(mean - SIGMAS * max(0.0, int(q) / n - mean * mean) ** 0.5)


def with_counts(rows: DataFrame) -> DataFrame:
    """Add the base rules' counts to rows that have _text (not null) and its words _w."""
    text, n = F.col("_text"), F.size("_w")
    has_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    rows = rows.withColumn("_lines", has_word)
    rows = rows.withColumn(
        "_windows",
        F.transform(
            F.slice("_w", F.lit(1), F.greatest(n - 4, F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(F.col("_w"), i + k) for k in range(1, 5)]),
        ),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn(
        "_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    twice = F.filter(
        "_sorted",
        lambda x, j: (j > 0) & (F.get(F.col("_sorted"), j - 1)["h"] == x["h"])
        | F.coalesce(F.get(F.col("_sorted"), j + 1)["h"] == x["h"], F.lit(False)),
    )
    rows = rows.withColumn("_hits", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    reach = F.transform("_hits", lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("_hits"), j + 1) - p, F.lit(5))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "*",
        n.cast("long").alias("_n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("_word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("_n_repeat_words"),
    )


FLAGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def judged(docs: DataFrame, labels: DataFrame, small: int = SMALL) -> DataFrame:
    """Every row of ``docs`` as the struct _row, with the columns of FLAGS. labels: (doc_id, quality). ``small``: trusted ids that are
    broadcast."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = stash(good)
    trusted = F.broadcast(trusted) if trusted.count() <= small else trusted.hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = ratio_table(texts, trusted)
    least = least_score(texts, trusted, ratios)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"), words(F.col("text")).alias("_w"))
    rows = with_score(with_counts(rows), ratios)
    failed = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    good_enough = F.col("_llr") >= least if least is not None else F.lit(True)
    counts = [F.col(f"_{name}").alias(name) for name in FLAGS[:5]]
    kept = ~failed & good_enough
    # The partition's number isn't deterministic, so a filter that uses it stays above this projection. Pushed below, it would
    # work out the counts anew for every word.
    fence = F.spark_partition_id().alias("_fence")
    return rows.select("_row", *counts, failed.alias("base_failed"), kept.alias("kept"), F.col("_llr").alias("llr"), fence)


def quality_flags(docs: DataFrame, labels: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and FLAGS."""
    return judged(docs.select("doc_id", "text"), labels, small).select("_row.doc_id", *FLAGS)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass."""
    return judged(docs, labels).where("kept and _fence >= 0").select("_row.*")
