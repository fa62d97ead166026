"""Ranked lexical search of many items at once, by buckets of impact vectors of decreasing length (after LEMP, Teflioudi et al. 2015).

A document is the vector of its impacts: for each term of an item, the term's weight times its saturated frequency, in whole numbers. An
item is the vector of its terms' counts, and a score their inner product, so the search is for the largest inner products. Vectors
are put in order of their Euclidean length, over all tasks, and taken in buckets of BUCKET:

1. Cauchy-Schwarz: a bucket whose longest vector times the item's length is below the item's threshold (its k-th best score so far) holds
   nothing for the item. So is one whose largest coordinates would not reach it.
2. Coordinate bounds: terms go in the order of what they can add at most within the bucket. Once those that are left can't reach the
   threshold by themselves, only documents that hold one of the terms before are candidates. A candidate is dropped if what it has so far
   and the lesser of two bounds on the rest, the largest coordinates' sum and Cauchy-Schwarz on what is left of both vectors, stay below.
3. Survivors are scored on the remaining terms, in whole numbers.

The longest vectors, a partition's worth, are searched first; their k-th best scores are the thresholds that all other tasks start from.
Only bounds use floating point, with slack; no document that could be among the k best, ties included, is dropped.

Items are taken in blocks of about BLOCK_TERMS terms, which is what is broadcast at a time and goes to the driver; each block
reads the documents twice, for counts and for vectors. Terms are known by 64-bit hashes.

Cases: a null text, or one without a term, has no vector and no rank; an item without terms, or whose terms no document has, gives no
row. Repeated rows are documents (or items) of their own. Equal scores go by doc_id, null last; rows equal in both are alike. Very
long texts are worked on whole. Empty tables give an empty result. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespark.llm.common import hashed_words, small_batches, stash
from cubespark.llm.text_batch import frame, lists, text_groups

K = 20
BUCKET = 2048
BLOCK_TERMS = 1 << 18
#: Groups in which an item's results are ranked before they meet.
SALTS = 64
_SLACK = 1 + 1e-9
_IS_TERM = np.ones(256, bool)
_IS_TERM[:128] = [chr(b).isalnum() for b in range(128)]


def term_counts(data: bytes, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts ``data[edge[i] : edge[i + 1]]``: the text, hash and count of each distinct term, sorted by text and hash, and the
    number of terms of each text."""
    raw = np.frombuffer(data.lower(), np.uint8)
    inside = _IS_TERM[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[edge] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1
    text = np.searchsorted(edge, start, "right") - 1
    order = np.argsort(term := hashed_words(raw, start, end), kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    text, term = text[order], term[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))) if len(text) else np.zeros(0, np.int64)
    return text[first], term[first].view(np.int64), np.diff(np.append(first, len(text))), np.bincount(text, minlength=len(edge) - 1)


# -- items -------------------------------------------------------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, edge in text_groups(batch["text"]):
            text, term, count, _ = term_counts(data, edge)
            row = pa.array(at + text)
            yield frame("item, item_id, term, count", batch["item"].take(row), batch["item_id"].take(row), term, count)


class Items:
    """A block of items: their numbers, ids and terms, the latter as places in ``vocabulary``."""

    def __init__(self, rows: pa.Table):
        item = rows["item"].to_numpy()
        self.item, begin, which = np.unique(item, return_index=True, return_inverse=True)
        self.item_id = rows["item_id"].combine_chunks().take(pa.array(begin))
        self.vocabulary, term = np.unique(rows["term"].to_numpy(), return_inverse=True)
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(len(self.item) + 1))
        count = rows["count"].to_numpy()
        self.terms = [(term[p], count[p]) for p in (order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]

    def places(self, term: np.ndarray) -> np.ndarray:
        """Where terms are in the vocabulary; -1 where they aren't."""
        at = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == term, at, -1)


# -- counts and vectors of documents -----------------------------------------------------------------------------------


def _counter(shared):
    """Per task: how many documents hold each term of the block; under the place -1 their number and, as ``more``, their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        holds, documents, terms = np.zeros(len(items.vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, data, edge in text_groups(batch["text"]):
                _, term, _, n = term_counts(data, edge)
                place = items.places(term)
                holds += np.bincount(place[place >= 0], minlength=len(holds))
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        some = np.flatnonzero(holds)
        yield frame("place, n, more", np.append(some, -1), np.append(holds[some], documents), np.append(some * 0, terms))

    return run


def weights(items: Items, counts: list[tuple[int, int, int]]) -> tuple[np.ndarray, int, int]:
    """The weight of each term of the vocabulary (0 if no document has it), the number of documents with terms, and of all their terms."""
    documents, terms = next(((n, more) for place, n, more in counts if place == -1), (0, 0))
    out = np.zeros(len(items.vocabulary), np.int64)
    for place, n, _ in counts:
        if place >= 0:
            out[place] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
    return out, documents, terms


_VECTORS = "doc_id long, length double, places array<int>, impacts array<long>"


def _vectors(shared):
    """The impact vectors of documents, over the terms of the block that have a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, documents, terms = shared.value
        for batch in batches:
            for at, data, edge in text_groups(batch["text"]):
                text, term, count, n = term_counts(data, edge)
                place = items.places(term)
                used = (place >= 0) & (weight[place] > 0)
                text, place, count = text[used], place[used], count[used].astype(np.int64)
                scale = 75 + 25 * n.astype(np.int64) * documents // max(terms, 1)
                impact = weight[place] * (1_000_000_000 * count // (1000 * count + 12 * scale[text]))
                text, place, impact = text[impact > 0], place[impact > 0], impact[impact > 0]
                size = np.bincount(text, minlength=len(n))
                length = np.sqrt(np.bincount(text, impact.astype(float) ** 2, len(n)))
                some = np.flatnonzero(size)
                doc_id = batch["doc_id"].take(pa.array(at + some))
                yield frame(_VECTORS, doc_id, length[some], lists(place.astype(np.int32), size[some]), lists(impact, size[some]))

    return run


# -- search ------------------------------------------------------------------------------------------------------------


class Best:
    """The k best of an item: scores down, then ids up, null (the largest number) last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least  # no score below ``least`` is wanted
        self.score, self.doc_id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc_id: np.ndarray) -> None:
        score, doc_id = np.append(self.score, score), np.append(self.doc_id, doc_id)
        order = np.lexsort((doc_id, -score))[: self.k]
        self.score, self.doc_id = score[order], doc_id[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


class Bucket:
    """Vectors as postings: for each place, which of them have it and with which impact."""

    def __init__(self, doc_id: np.ndarray, length: np.ndarray, size: np.ndarray, place: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.doc_id, self.length = doc_id, length
        order = np.argsort(place, kind="stable")
        self.row, self.impact = np.repeat(np.arange(len(size)), size)[order], impact[order]
        self.begin = np.searchsorted(place[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        used = np.flatnonzero(np.diff(self.begin))
        if len(used):
            self.most[used] = np.maximum.reduceat(self.impact, self.begin[used])

    def search(self, place: np.ndarray, count: np.ndarray, best: Best) -> int:
        """Add to ``best`` what this bucket has for an item; how many vectors were scored in full."""
        adds = count * self.most[place]
        if not len(adds) or self.length.max() * math.sqrt(float(count @ count)) * _SLACK < best.least:
            return 0
        order = np.argsort(-adds, kind="stable")
        order = order[adds[order] > 0]
        place, count, adds = place[order], count[order], adds[order]
        rest = np.append(np.cumsum(adds[::-1])[::-1], 0)  # what the terms from each one on can add at most
        if rest[0] < max(best.least, 1):
            return 0
        first = int(np.searchsorted(-rest, -best.least, "right"))  # terms from here on don't reach the threshold alone
        first = min(max(first, 1), len(place))
        score, square = np.zeros(len(self.length), np.int64), np.zeros(len(self.length))
        for p, c in zip(place[:first].tolist(), count[:first].tolist(), strict=True):
            a, b = self.begin[p], self.begin[p + 1]
            score[self.row[a:b]] += c * self.impact[a:b]
            square[self.row[a:b]] += self.impact[a:b].astype(float) ** 2
        alive = np.flatnonzero(score)
        tail = count[first:].astype(float)
        left = np.sqrt(np.maximum(self.length[alive] ** 2 * _SLACK - square[alive], 0)) * math.sqrt(float(tail @ tail)) * _SLACK
        alive = alive[score[alive] + np.minimum(left, float(rest[first])) >= best.least]
        if not len(alive):
            return 0
        total = score[alive]
        for p, c in zip(place[first:].tolist(), count[first:].tolist(), strict=True):
            a, b = self.begin[p], self.begin[p + 1]
            at = np.minimum(np.searchsorted(self.row[a:b], alive), b - a - 1)
            total += np.where(self.row[a:b][at] == alive, c * self.impact[a:b][at], 0)
        good = total >= max(best.least, 1)
        best.add(total[good], self.doc_id[alive[good]])
        return len(alive)


_FOUND = "item long, item_id long, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).max


def _searcher(shared, k: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, thresholds = shared.value
        best = [Best(k, int(t)) for t in thresholds]
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                part = batch.slice(at, bucket)
                place, impact = part["places"], part["impacts"]
                size = place.value_lengths().to_numpy()
                doc_id = part["doc_id"].fill_null(_NO_ID).to_numpy()
                vectors = Bucket(doc_id, part["length"].to_numpy(), size, place.flatten().to_numpy(), impact.flatten().to_numpy(), len(items.vocabulary))
                for (p, c), b in zip(items.terms, best, strict=True):
                    vectors.search(p, c, b)
        found = [len(b.score) for b in best]
        item = np.repeat(np.arange(len(best)), found)
        score, doc_id = (np.concatenate([np.zeros(0, np.int64), *(getattr(b, x) for b in best)]) for x in ("score", "doc_id"))
        yield frame(_FOUND, items.item[item], items.item_id.take(pa.array(item)), pa.array(doc_id, mask=doc_id == _NO_ID), score)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first in SALTS groups, so that no task gets all that the tasks have found for an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: Items, k: int, bucket: int) -> DataFrame:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    counts = docs.mapInArrow(_counter(share(items)), "place long, n long, more long").groupBy("place").agg(F.sum("n"), F.sum("more"))
    weight, documents, terms = weights(items, [tuple(r) for r in counts.collect()])  # a row for each term of the block
    vectors = docs.mapInArrow(_vectors(share((items, weight, documents, terms))), _VECTORS)
    # Copies have equal lengths, so a hash of the whole row tells them apart; a range can be cut anywhere.
    order = [F.desc("length"), F.xxhash64("doc_id", "places")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = stash(vectors.repartitionByRange(parts, *order).sortWithinPartitions(F.desc("length")).withColumn("part", F.spark_partition_id()))
    none = np.zeros(len(items.item), np.int64)
    head = stash(vectors.where("part = 0").drop("part").mapInArrow(_searcher(share((items, none)), k, bucket), _FOUND))
    ends = _ranked(head, k).where(F.col("rank") == k).select("item", "score").collect()  # a row for each item of the block
    thresholds = none.copy()
    for item, score in ends:
        thresholds[np.searchsorted(items.item, item)] = score
    rest = vectors.where("part > 0").drop("part").mapInArrow(_searcher(share((items, thresholds)), k, bucket), _FOUND)
    return _ranked(head.unionByName(rest), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, bucket: int = BUCKET) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) with a score above 0 of each item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark, 4)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    terms = stash(numbered.mapInArrow(_item_terms, "item long, item_id long, term long, count long"))
    blocks = max(1, math.ceil(terms.count() / block_terms))
    out = None
    for block in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = some.toArrow().combine_chunks()
        if rows.num_rows:
            found = _search_block(texts, Items(rows), k, bucket)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
