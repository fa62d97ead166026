"""Repeated passages: near-equal paragraphs across and within documents, by MinHash banding.

A paragraph is a line (split at \\n) of at least MIN_WORDS words. Its set holds the hashes of its distinct five-word
shingles. Equal sets are one vertex; the others meet by bands of min-wise hashes, whose number tune_bands() chooses so that
a pair at the similarity threshold is missed with a probability of at most 1e-4. Colliding paragraphs are verified by exact
Jaccard similarity of the full sets, and the components of the verified links are the clusters. In each cluster the first
occurrence, by doc_id and then position, stays; the others are removals.

A passage can also sit inside longer text, over any lines. So what is left of a document, after whole paragraphs are gone, is taken
as grams of RUN words, and the least of every SPREAD grams in a row is a seed: each repeat of RUN + SPREAD - 1 words holds one.
Around the seeds that stand in different documents all grams are compared, and those that stand in different documents make up
the passages, which so reach to their first and last common word of two characters or more (a list mark or dash at an end stays)
and have RUN words or more.
A gram's first occurrence stays. Paragraphs that stay, of whatever cluster they are the first, take part.

Cases: a null text has no paragraphs. A null doc_id comes after all others, and texts without one count as one document for
passages inside text. Rows that repeat a doc_id are one document: their paragraphs repeat each other, and those at the same place stay
or go together. An empty table gives an empty result. Other columns, whatever their names, don't matter. Very long texts are worked on whole, each in one task, in memory of some 60 bytes a word. Words are compared without
regard to the case of A-Z. Lines of fewer than MIN_WORDS words are never clustered as paragraphs; a line of fewer words than a shingle
(with a smaller ``least``) has its whole word sequence as its one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from cubespark.llm import linking
from cubespark.llm.common import mix, of_keys, small_batches, stash, with_rank
from cubespark.llm.text_batch import Group, arrow_task, frame, lists
from cubespark.sources.store import discard

MIN_WORDS = 15
SHINGLE = 5
THRESHOLD = 0.8
#: Words of a gram, and grams of which one is a seed.
RUN = 15
SPREAD = 16


def tune_bands(threshold: float, recall: float = 1 - 1e-4, most: int = 16) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance collisions, that reach ``recall`` with ``most`` bands."""
    best, rows = (most, 1), 1
    while (bands := math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) <= most:
        best, rows = (bands, rows), rows + 1
    return best


BANDS, ROWS = tune_bands(THRESHOLD)


def band_keys(minhash: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of signatures."""
    band = minhash[:, : BANDS * ROWS].astype(np.uint64).reshape(len(minhash), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minhash), BANDS))
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + band[:, :, k])
    return h.view(np.int64)


_SIGNED = "doc_id long, key long, paragraph int, start int, end int, id long, n int, keys array<long>, lines array<int>, ends array<int>"


def _sign(least: int):
    """Paragraphs with their band keys, and one row for each document's seeds (in keys) with their first and last lines, n = 0.

    A task gives the keys of a set once, so that a paragraph that is everywhere doesn't fill its buckets with itself."""
    seen: set[int] = set()

    def task(batch: pa.RecordBatch, group: Group) -> Iterator[pa.RecordBatch]:
        if len(seen) > 1 << 20:  # memory stays bounded; later repeats are given again
            seen.clear()
        lines = group.paragraphs(least)
        if len(lines):
            shingles, begin = group.shingles(*group.spans_of_lines(lines), SHINGLE)
            ids, n = linking.set_ids(shingles, begin)
            keys = band_keys(linking.minhash_rows(shingles, begin, BANDS * ROWS))
            new = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()])
            doc = group.line_doc[lines]
            ends = [group.points(x[lines], doc).astype(np.int32) for x in (group.line_start, group.line_end)]
            none = lists(np.zeros(0, np.int32), np.zeros(len(lines), np.int64))
            number = (lines - group.first_line[doc]).astype(np.int32)
            yield _rows(batch, group.at + doc, number, *ends, ids, n.astype(np.int32), lists(keys[new].ravel(), new * BANDS), none, none)
        gram, at = group.grams(RUN)
        chosen = group.seeds(gram, at, SPREAD)
        first = at[chosen]
        doc = group.doc[first]
        size = np.bincount(doc, minlength=group.docs)
        some, zero = np.flatnonzero(size), np.zeros(np.count_nonzero(size), np.int32)
        spans = [lists((group.line[x] - group.first_line[doc]).astype(np.int32), size[some]) for x in (first, first + RUN - 1)]
        yield _rows(batch, group.at + some, zero, zero, zero, zero.astype(np.int64), zero, lists(gram[chosen].view(np.int64), size[some]), *spans)

    return arrow_task(task)


def _rows(batch: pa.RecordBatch, rows: np.ndarray, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Columns behind the ids of the batch's ``rows``, named as in _SIGNED."""
    ids = [batch[c].take(pa.array(rows)) for c in ("doc_id", "key")]
    return frame(_SIGNED, *ids, *columns)


_SETS = "id long, n int, s0 long, s1 long, s2 long, members array<long>"


def _sets(least: int):
    """The sets of the paragraphs ``numbers``, with their sketches."""

    def task(batch: pa.RecordBatch, group: Group) -> Iterator[pa.RecordBatch]:
        numbers = batch["numbers"].slice(group.at, group.docs)
        wanted = np.repeat(group.first_line, numbers.value_lengths().to_numpy()) + numbers.flatten().to_numpy()
        lines = np.intersect1d(group.paragraphs(least), wanted)
        if len(lines):
            shingles, begin = group.shingles(*group.spans_of_lines(lines), SHINGLE)
            ids, n = linking.set_ids(shingles, begin)
            sketch = linking.sketch_rows(linking.minhash_rows(shingles, begin, linking.SKETCH_SLOTS))
            yield frame(_SETS, ids, n.astype(np.int32), *sketch.T, lists(shingles.view(np.int64), n))

    return arrow_task(task)


_GRAMS = "row long, doc_id long, gram long, place int, trim int, line int, start int, end int"


def _grams() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The grams around ``seeds`` that don't touch the lines ``gone``: the number of their first word, its line, and code points
    from the first to the last word, without words of one character at the ends (``trim``: how many at either)."""

    def task(batch: pa.RecordBatch, group: Group) -> Iterator[pa.RecordBatch]:
        gram, at = group.grams(RUN)
        if not len(gram):
            return
        given = {c: batch[c].slice(group.at, group.docs) for c in ("seeds", "gone")}
        flat = {c: (np.repeat(np.arange(group.docs), x.fill_null([]).value_lengths().to_numpy()), x.flatten().to_numpy()) for c, x in given.items()}
        doc = group.doc[at]
        live = ~np.isin(np.arange(len(group.line_start)), group.first_line[flat["gone"][0]] + flat["gone"][1])
        live = live[group.line[at]] & live[group.line[at + RUN - 1]]
        seed = np.isin(gram, flat["seeds"][1].view(np.uint64))  # those of other texts of the group do no harm
        hit = np.concatenate(([0], np.cumsum(seed)))
        place = np.arange(len(gram))
        near = hit[np.minimum(place + SPREAD, len(gram))] > hit[np.maximum(place - SPREAD + 1, 0)]
        chosen = np.flatnonzero(near & live)
        first, doc = at[chosen], doc[chosen]
        wide = np.diff(group.points(np.stack((group.start, group.end)), group.doc), axis=0)[0] > 1
        number = np.arange(len(wide))
        after = np.minimum.accumulate(np.where(wide, number, len(wide) - 1)[::-1])[::-1]  # the next word of two characters or more
        before = np.maximum.accumulate(np.where(wide, number, 0))
        last = first + RUN - 1
        a, b = np.minimum(after[first], last), np.maximum(before[last], first)
        a, b = np.where(a <= b, a, first), np.where(a <= b, b, last)
        trim = (a - first) * RUN + last - b
        base = np.searchsorted(group.doc, np.arange(group.docs))
        columns = [
            batch["row"].take(pa.array(group.at + doc)), batch["doc_id"].take(pa.array(group.at + doc)), gram[chosen].view(np.int64),
            *[x.astype(np.int32) for x in (first - base[doc], trim, group.line[a] - group.first_line[doc], group.points(group.start[a], doc), group.points(group.end[b], doc))],
        ]
        yield frame(_GRAMS, *columns)

    return arrow_task(task)


def repeated_seeds(seeds: DataFrame) -> DataFrame:
    """Of (doc_id, key, seed) the seeds that stand in two documents or more, as one array for each key."""
    ends = _in_two(seeds.groupBy("seed")).select("seed")
    return seeds.join(ends.hint("merge"), "seed", "left_semi").groupBy("key").agg(F.collect_set("seed").alias("seeds"))


def _in_two(groups: GroupedData, *more: Column) -> DataFrame:
    """The groups with rows of two documents or more; ends are combined before the shuffle, so a hot group is no task of its own."""
    doc = F.coalesce("doc_id", F.lit(2**63 - 1))
    return groups.agg(F.min(doc).alias("_low"), F.max(doc).alias("_high"), *more).where("_low < _high").drop("_low", "_high")


def inner_passages(live: DataFrame) -> DataFrame:
    """The runs of grams (as _GRAMS) that stand in two documents or more."""
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("kept")
    found = live.join(_in_two(live.groupBy("gram"), kept, F.count("*").alias("cluster_size")).hint("merge"), "gram")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("place") == F.col("kept.place"))
    found = found.select("*", (~stays).alias("removed"), F.col("kept.doc_id").alias("kept_doc_id"))
    w = Window.partitionBy("row").orderBy("place")
    same = ["cluster_size", "removed", "kept_doc_id"]
    new = F.coalesce(F.lag("place").over(w) != F.col("place") - 1, F.lit(True))
    for c in same:
        new |= ~F.lag(c).over(w).eqNullSafe(F.col(c))
    runs = found.withColumn("_new", new).withColumn("_run", F.count_if("_new").over(w)).groupBy("row", "doc_id", "_run", *same)
    ends = F.min("line").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end")
    left, right = F.floor(F.min_by("trim", "place") / RUN), F.max_by("trim", "place") % RUN
    words = F.max("place") - F.min("place") + RUN - left - right
    found = runs.agg(*ends, words.alias("_words"), F.min_by("gram", "place").alias("cluster_id"))
    return found.where(F.col("_words") >= RUN).drop("row", "_run", "_words")


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, threshold: float = THRESHOLD, small: int = linking.SMALL) -> DataFrame:
    """One row per paragraph, or passage inside longer text, of ``docs`` (doc_id, text) that has a (near-)equal one elsewhere: doc_id,
    paragraph (where it begins), start, end, cluster_id, cluster_size, removed, kept_doc_id (the document in which the cluster's
    first occurrence stays). Passages of different clusters may overlap. ``small``: see linking.linked_components()."""
    small_batches(docs.sparkSession, 4)
    least = max(least, 1)
    # Texts without an id are told apart by a hash, so that they don't all meet.
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("key"), "text")
    stored = stash(keyed.mapInArrow(_sign(least), _SIGNED))
    signed = stored.where("n > 0")
    whole = stash(_paragraph_clusters(keyed, signed, least, threshold, small))

    gone = whole.where("removed").groupBy(F.coalesce("doc_id", "key").alias("key")).agg(F.collect_set("paragraph").alias("gone"))
    seeds = stored.where("n = 0").select("doc_id", "key", "keys", "lines", "ends").join(gone.hint("merge"), "key", "left")
    each = seeds.select("doc_id", "key", "gone", F.explode(F.arrays_zip("keys", "lines", "ends")).alias("s"))
    # A line of MIN_WORDS words or more that touches a gram holds its first or last word.
    out = F.array_contains("gone", F.col("s.lines")) | F.array_contains("gone", F.col("s.ends"))
    live = each.where(~F.coalesce(out, F.lit(False))).select("doc_id", "key", F.col("s.keys").alias("seed"))
    wanted = repeated_seeds(live).join(gone.hint("merge"), "key", "left")
    read = of_keys(keyed, wanted, "key").withColumn("row", F.monotonically_increasing_id())
    grams = stash(read.select("row", "doc_id", "text", "seeds", "gone").mapInArrow(_grams(), _GRAMS))
    discard(stored)  # the largest table here: the result reads only ``whole`` and ``grams``
    inside = inner_passages(grams)
    whole = whole.drop("key")
    return whole.unionByName(inside.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in whole.schema]))


def _paragraph_clusters(keyed: DataFrame, signed: DataFrame, least: int, threshold: float, small: int) -> DataFrame:
    """The paragraphs of clusters of two or more, and whether each is a removal."""
    buckets = linking.shared_buckets(signed.select("id", F.explode("keys").alias("key")))
    involved = stash(buckets.select("id").distinct())
    wanted = signed.select("key", "paragraph", "id").join(involved.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("key", "paragraph")).alias("p"))
    wanted = wanted.groupBy(F.col("p.key").alias("key")).agg(F.collect_set("p.paragraph").alias("numbers"))
    read = of_keys(keyed, wanted, "key").select("text", "numbers").mapInArrow(_sets(least), _SETS)
    sets = stash(read.join(involved.hint("merge"), "id", "left_semi").dropDuplicates(["id"]))
    labels = linking.linked_components(buckets, sets.drop("members"), sets.select("id", "members"), threshold, small)
    discard(sets)
    places = signed.select("doc_id", "key", "paragraph", "start", "end", "id")
    placed = places.join(labels.hint("merge"), "id", "left").withColumn("cluster_id", F.coalesce("label", "id")).drop("label", "id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "paragraph", "start")).alias("first")
    clusters = placed.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"), first).where("cluster_size > 1")
    found = placed.join(clusters.hint("merge"), "cluster_id")
    stays = (F.col("key") == F.col("first.key")) & (F.col("start") == F.col("first.start"))
    return found.select(
        "doc_id", "key", "paragraph", "start", "end", "cluster_id", "cluster_size", (~stays).alias("removed"), F.col("first.doc_id").alias("kept_doc_id")
    )


def _cut(text: str | None, spans: object) -> str | None:
    if text is None or spans is None:
        return text
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        out.append(text[at:start])  # empty where spans overlap
        at = max(at, end) + (end >= at and text[end : end + 1] == "\n" and (start == 0 or text[start - 1] == "\n"))  # a whole line goes with its end
    return "".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, least: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the removals, which are cut from the texts. Here a document is an id with a text: rows that repeat both lose the
    same spans, other texts of the same id, or without one, are judged by themselves (in the order of ids, null last, then of the
    texts' hashes)."""
    by = [F.col("doc_id").isNull().alias("_none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id")]
    # Numbers in that order stand for the ids, so that each is one document's.
    numbered = with_rank(docs.select(*by).distinct(), ["_none", "doc_id", "text_id"], "number", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).drop("_none")
    numbered = stash(numbered).alias("n")

    def joined(rows: DataFrame) -> DataFrame:
        same = F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.text_id") == F.col("n.text_id"))
        return rows.alias("r").join(numbered.hint("merge"), same)

    texts = joined(docs.select(*by[1:], "text")).select(F.col("n.number").alias("doc_id"), "r.text").dropDuplicates(["doc_id"])
    gone = repeated_passages(stash(texts), least, threshold).where("removed")
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc_id", "number")
    cut = F.pandas_udf(lambda texts, spans: pd.Series(map(_cut, texts, spans), dtype=object), "string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *by[1:])  # a struct, so that no name clashes
    spans = joined(rows).select("r._row", "n.number").join(gone.hint("merge"), "number", "left")
    new = spans.select("_row", cut(F.col("_row.text"), F.col("spans")).alias("_new"))
    return new.select(*[F.col("_new").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
