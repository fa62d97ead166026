"""Near-duplicate documents by a multi-index Hamming join over b-bit min-wise signatures.

A document's set holds the hashes of its distinct word shingles. Its signature has SLOTS symbols of 8 bits, split into
CHUNKS chunks of 7 symbols. Two signatures that differ in at most 2 * CHUNKS - 1 = 23 symbols have a chunk in which at
most one symbol differs (pigeonhole), so listing each chunk with each one of its symbols left out finds every such pair.
Each listing is 6 symbols and the chunk's and the omitted symbol's number: it fits a long without hashing. A pair at
similarity s differs in about (1 - s) * 84 symbols; at s = 0.8 exactly, the same index misses a pair with a probability of
3e-5, as each of the 12 chunks has at most one error with a probability of 0.58. Candidates are confirmed on full sets.

Cases: a null text, or one without words, has an empty set and is linked with nothing. A text shorter than the shingle has
its whole word sequence as one shingle. Very long texts are worked on whole, each in one task, in memory of some 60 bytes a word. Rows
with equal sets are in one component; repeated rows and repeated or null ids are kept as rows, and a component's id is its smallest
non-null doc_id (a row without one in it gets null). An empty table gives an empty result. Other columns of the input, whatever their
names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm import linking
from cubespark.llm.common import of_keys, small_batches, stash
from cubespark.llm.text_batch import Group, arrow_task, frame, lists

CHUNKS, WIDE = 12, 7
SLOTS = CHUNKS * WIDE
_SIGNED = "doc_id long, text_id long, key long, id long, n int, s0 long, s1 long, s2 long, keys array<long>"
_SETS = "id long, members array<long>"


def signature_keys(minhash: np.ndarray) -> np.ndarray:
    """The keys of a signature, or of each row of them: for each chunk and each symbol left out, the other six with both numbers."""
    chunk = linking.symbols(minhash).reshape(*minhash.shape[:-1], CHUNKS, WIDE)
    shift = np.arange(WIDE - 1, dtype=np.uint64) * np.uint64(8)
    out = np.empty((*chunk.shape,), np.uint64)
    for drop in range(WIDE):
        kept = np.delete(chunk, drop, axis=-1)
        place = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDE) + np.uint64(drop)) << np.uint64(48)
        out[..., drop] = (kept << shift).sum(axis=-1, dtype=np.uint64) | place
    return out.reshape(*minhash.shape[:-1], CHUNKS * WIDE).view(np.int64)


def _sign(width: int):
    """A row for each text: ids, the set's id and size, sketch and keys; a size of 0 and no keys without words."""

    def task(batch: pa.RecordBatch, group: Group) -> Iterator[pa.RecordBatch]:
        first, count = group.spans_of_texts()
        some = np.flatnonzero(count)
        ids, n, sketch = np.zeros(group.docs, np.int64), np.zeros(group.docs, np.int32), np.zeros((group.docs, linking.SKETCH_WORDS), np.int64)
        keys = np.zeros((0, CHUNKS * WIDE), np.int64)
        if len(some):
            shingles, begin = group.shingles(first[some], count[some], width, wide=True)
            minhash = linking.minhash_rows(shingles, begin, SLOTS)
            ids[some], n[some] = linking.set_ids(shingles, begin)
            sketch[some], keys = linking.sketch_rows(minhash), signature_keys(minhash)
        given = [batch[c].slice(group.at, group.docs) for c in ("doc_id", "text_id", "key")]
        yield frame(_SIGNED, *given, ids, n, *sketch.T, lists(keys.ravel(), (count > 0) * keys.shape[1]))

    return arrow_task(task)


def _members(width: int):
    def task(batch: pa.RecordBatch, group: Group) -> Iterator[pa.RecordBatch]:
        first, count = group.spans_of_texts()
        some = np.flatnonzero(count)
        if len(some):
            shingles, begin = group.shingles(first[some], count[some], width, wide=True)
            ids, n = linking.set_ids(shingles, begin)
            yield frame(_SETS, ids, lists(shingles.view(np.int64), n))

    return arrow_task(task)


def _placed(docs: DataFrame, shingle: int, threshold: float, small: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_id (the text's hash), n, and label, which is the same within a component."""
    small_batches(docs.sparkSession, 4)
    doc_id, text_id = F.col("doc_id").cast("long"), F.xxhash64("text")
    texts = docs.select(doc_id.alias("doc_id"), text_id.alias("text_id"), F.coalesce(doc_id, text_id).alias("key"), "text")
    signed = stash(texts.mapInArrow(_sign(shingle), _SIGNED))
    vertices = signed.where("n > 0")
    keyed = vertices.select("id", "keys").dropDuplicates(["id"]).select("id", F.explode("keys").alias("key"))
    buckets = linking.shared_buckets(keyed)
    involved = buckets.select("id").distinct()
    one = (
        vertices.join(involved.hint("merge"), "id", "left_semi")
        .groupBy("id")
        .agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "s2")])
    )
    one = stash(one)
    chosen = of_keys(texts.select("key", "text"), one.select("key").distinct(), "key")
    sets = chosen.select("text").mapInArrow(_members(shingle), _SETS)
    sets = stash(sets.join(one.select("id").hint("merge"), "id", "left_semi").dropDuplicates(["id"]))
    labels = linking.linked_components(buckets, one.drop("key"), sets, threshold, small)
    placed = signed.select("doc_id", "text_id", "id", "n").join(labels.hint("merge"), "id", "left")
    return placed.select("doc_id", "text_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "id")).alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, small: int = linking.SMALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept. ``small``: see linking.linked_components()."""
    placed = _placed(docs, shingle, threshold, small)
    least = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return placed.join(least.hint("merge"), "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, small: int = linking.SMALL) -> DataFrame:
    """The rows of ``docs`` of which one document per component stays: that of the smallest doc_id (null last), then of the smallest
    hash of its text. Documents are rows of different ids or texts; rows that repeat both are one document, which stays or goes whole.
    Rows without words stay."""
    placed = stash(_placed(docs, shingle, threshold, small))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    first = placed.where("label is not null").groupBy("label").agg(F.min(order).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    gone = placed.join(first.hint("merge"), "label").where(~stays).select("doc_id", "text_id").distinct().alias("g")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("text").alias("_text"))  # a struct, so that no name clashes
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.col("_text") == F.col("g.text_id"))
    return rows.join(gone.hint("merge"), same, "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
