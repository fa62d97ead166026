"""Language identification with a bit-sliced Bloom filter over character n-grams.

Fitting. From at most FIT_ROWS labelled documents (those of the smallest id hash), the share of each n-gram of 3 and 4
characters among a language's n-grams is counted in Spark. A language keeps an n-gram if its share there is at least RIVAL
times the largest share in any language; of those, the TOP most frequent. The filter is one table of SLOTS masks, a bit per
language: an n-gram sets its language's bit in HASHES slots. Its size is bounded by SLOTS and the number of languages.

Predicting. For every n-gram of a text the AND of its slots' masks gives all languages that contain it. Per language the
set bits are counted, and the share of hits is corrected for false positives: with f the share of slots that have the bit,
an absent n-gram hits with a probability of f ** HASHES. The largest corrected share wins; a tie goes to the language
first in code-point order. The score is the winner's part of the sum of shares.

Cases: a null text or one without a letter is ``und`` with a score of 0, and so is everything if nothing could be learned. A
text with letters but no hit gets the first learned language with an equal share as its score. Rows stand for themselves;
repeated rows repeat, a null id counts as not held out, an empty table gives an empty result. Very long texts are read whole, in
memory of some 100 bytes a character. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespark.llm.common import bounded_sample, held_out, keyed_texts, mix, small_batches, with_long

FIT_ROWS = 8_000
ORDERS = (3, 4)
TOP = 20_000
RIVAL = 0.5
SLOTS, HASHES = 1 << 20, 3
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of a text in lower case, other characters than letters counting as one blank."""
    point = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[point]
    if not letter.any():
        return np.zeros(0, np.uint64)
    point = np.where(letter, point, 32)
    point = point[letter | np.concatenate(([True], letter[:-1]))].astype(np.uint64)
    point = np.concatenate((np.full(1, 32, np.uint64), point, np.full(1, 32, np.uint64)))
    out = []
    for n in ORDERS:
        if len(point) >= n:
            h = point[: len(point) - n + 1].copy()
            for k in range(1, n):
                h = (h << np.uint64(21 if n == 3 else 16)) ^ point[k : len(point) - n + 1 + k]
            out.append(mix(h ^ np.uint64(n << 60)))
    return np.concatenate(out)


@dataclass
class Filter:
    """The fitted filter: ``masks`` has a row of 64-bit masks for each 64 languages."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def build(grams: dict[str, np.ndarray]) -> Filter:
        languages = sorted(grams)
        masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
        rate = np.zeros(len(languages))
        for i, language in enumerate(languages):
            bit = np.uint64(1 << (i % 64))
            for slots in _slots(grams[language]):
                masks[i // 64][slots] |= bit
            rate[i] = np.count_nonzero(masks[i // 64] & bit) / SLOTS
        return Filter(languages, masks, rate**HASHES)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text or "")
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        slots = _slots(grams)
        hits = np.empty(len(self.languages))
        for block, table in enumerate(self.masks):
            found = functools.reduce(np.bitwise_and, (table[s] for s in slots))
            for i in range(block * 64, min(len(hits), block * 64 + 64)):
                hits[i] = np.count_nonzero(found & np.uint64(1 << (i % 64)))
        share = np.maximum(0.0, (hits / len(grams) - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9))
        best = int(np.argmax(share))
        total = share.sum()
        return self.languages[best], float(share[best] / total) if total else 1 / len(share)


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    """HASHES slots of each n-gram, from disjoint bits of its hash."""
    return [((grams >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            found = [g for g in map(ngrams, texts) if len(g)]
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Filter:
    """The filter of the labelled rows of ``docs`` (doc_id, text, lang), of at most ``fit_rows`` of them."""
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    chosen = bounded_sample(rows.select("doc_id"), "doc_id", fit_rows).distinct()
    counts = rows.join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInPandas(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    own = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= RIVAL * F.col("most"))
    top = own.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= TOP)
    by: dict[str, list[int]] = {}
    for lang, gram in top.select("lang", "gram").collect():  # TOP rows a language at most
        by.setdefault(lang, []).append(gram)
    return Filter.build({k: np.array(v, np.int64).view(np.uint64) for k, v in by.items()})


def predict_language(docs: DataFrame, model: Filter) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = pd.DataFrame([shared.value.predict(text) for text in batch["text"]], columns=["lang_pred", "score"])
            yield pd.concat([batch[["doc_id", "held_out"]], said], axis=1)

    rows = keyed_texts(docs, held_out(F.col("doc_id")).alias("held_out"))
    return with_long(rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double"), "doc_id")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out and predict all of them."""
    return predict_language(docs, fit(docs.where(~held_out(F.col("doc_id")))))
