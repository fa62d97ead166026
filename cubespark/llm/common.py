"""Helpers shared by the training-data operators: durable intermediate tables, ranks, samples and word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubespark.sources.store import cut_lineage

#: The white space that separates words everywhere in this subpackage: space and the ASCII controls 9 to 13.
SPACE = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


stash = cut_lineage


def keyed_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, more) for Python tasks. The id goes there as a string: pandas turns longs beside nulls into floats, which
    are not exact above 2 ** 53."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", *more)


def with_long(df: DataFrame, *columns: str) -> DataFrame:
    """Columns that went through Python as strings as longs again."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def small_batches(spark: SparkSession, mb: int = 16) -> None:
    """Bound the bytes of an Arrow batch, so that a run of very long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


#: Slots of the filter in of_keys(): the most rows that it broadcasts.
SLOTS = 1 << 20


def of_keys(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``wanted``, which has one row for each of its values of ``key``.

    Both sides may be of any size, so they are joined by merge. The rows of other keys are left out before they are shuffled, as far
    as the hashes of the wanted keys, in SLOTS slots, tell them apart: that table of SLOTS rows at most is broadcast."""
    wanted = stash(wanted)
    slots = wanted.select(F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("_slot")).distinct()
    near = rows.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
    return near.join(wanted.hint("merge"), key)


def words(text: Column) -> Column:
    """The words of a text, split at SPACE; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those of the smallest hash of ``key``: the same rows on every run and partitioning."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(bound)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal digits is 2 modulo 4. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def with_rank(rows: DataFrame, by: list[str], name: str, partitions: int) -> DataFrame:
    """Add the 0-based global position in the order of ``by`` without a single-task window.

    Rows are range-partitioned and stored; only one count per partition comes to the driver.
    """
    sorted_rows = stash(
        rows.repartitionByRange(partitions, *by).withColumn("_part", F.spark_partition_id())
    )
    counts = sorted_rows.groupBy("_part").count().collect()
    offsets, total = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in counts):
        offsets += [F.lit(part), F.lit(total)]
        total += n
    window = Window.partitionBy("_part").orderBy(*by)
    offset = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    return sorted_rows.withColumn(name, (F.row_number().over(window) - 1 + offset).cast("long")).drop("_part")


# -- hashes of words, for code in Python tasks -------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_IS_SPACE] = 0
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _power, _inverse = out
    return _power, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ``data`` as an array, and the starts and ends of its words (by SPACE)."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[raw], [True])).view(np.int8)))
    return raw, edge[::2], edge[1::2]


def is_space(raw: np.ndarray) -> np.ndarray:
    """Which bytes are SPACE."""
    return _IS_SPACE[raw]


_HASH_BYTES = 1 << 17


def hashed_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each of the words that begin and end at these bytes; in blocks, so that a long text takes little memory."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _HASH_BYTES, "right")))
        low, high = int(start[at]), int(end[to - 1])
        power, inverse = _powers(high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * power[: high - low], dtype=np.uint64, out=total[1:])
        out[at:to] = (total[end[at:to] - low] - total[start[at:to] - low]) * inverse[start[at:to] - low]
        at = to
    return mix(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of UTF-8 ``data``, with the words' byte starts and ends."""
    raw, start, end = word_spans(data)
    return hashed_words(raw, start, end), start, end


def shingle_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence if it is shorter; none without words."""
    if not len(word):
        return word
    runs = max(1, len(word) - width + 1)
    h = np.full(runs, min(width, len(word)), np.uint64)
    for k in range(min(width, len(word))):
        h = mix(h * np.uint64(_BASE) + word[k : k + runs])
    return np.unique(h)
