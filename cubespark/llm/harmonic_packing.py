"""Harmonic packing: documents as token ids into sequences of a fixed capacity, each worker by itself.

A length n is of class j = capacity // n, the reciprocal class (capacity / (j + 1), capacity / j], and a bin of class j takes j pieces:
a fixed count, so no bin is ever searched. What j pieces of class j leave free, under capacity / (j + 1), is filled with pieces cut
from the documents of the lowest class that is left, since class 1 would by itself fill its bins worst. So every bin is full. What
remains when no class can fill a bin (under j pieces of each class) is laid end to end and cut at the capacity, and the last stretch is
cut into powers of two, which need no padding. Documents longer than the capacity give whole sequences first. The rest of a document
stays in one piece unless it fills a gap.

A worker packs blocks of at most BLOCK tokens, or one longer document, of the rows that it reads: nothing is shuffled, no row waits for
another worker, memory is bounded by a block and the longest text, and a lost task is done again from its own rows.

Cases: null and empty texts have the end id alone. Repeated rows and repeated or null ids are packed as rows of their own. Very long
texts are worked on whole. An empty table gives an empty result. Other columns, whatever their names, don't matter. Ties go by the
order of rows. ``sequence_id`` is the task's number and a count, so sequences of different workers never share one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import small_batches
from cubespark.llm.text_batch import frame, text_groups
from cubespark.llm.tokens import Encoder

CAPACITY = 2048
#: Tokens that are packed together.
BLOCK = 1 << 22
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int, int, int]


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> list[Piece]:
    """(item, start, length, sequence, offset) of pieces that hold each of ``sizes``, which are at least 1, exactly once."""
    out: list[Piece] = []
    sequence = 0
    rest: list[tuple[int, int, int]] = []  # (class, item, start) of what is left of an item after whole sequences
    for item, n in enumerate(sizes):
        for start in range(0, n - capacity + 1, capacity):
            out.append((item, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((capacity // (n % capacity), item, n - n % capacity))
    rest.sort(key=lambda x: x[0])  # stable: by class, then in the order of items
    left = [[item, start, sizes[item]] for _, item, start in rest]  # item, and the span that no piece holds yet
    front, back, loose = 0, len(rest), []
    waiting = sum(end - start for _, start, end in left)  # tokens from front to back

    def cut(most: int) -> tuple[int, int, int]:
        """A piece of at most ``most`` tokens from the front."""
        nonlocal front, waiting
        item, start, end = left[front]
        length = min(most, end - start)
        left[front][1] += length
        waiting -= length
        front += start + length == end
        return item, start, length

    while back > front:
        j = rest[back - 1][0]
        whole = front + (left[front][1] > rest[front][2])  # the first that no piece was cut from
        if back - j < whole or rest[back - j][0] != j:  # too few for a bin of this class
            back -= 1
            loose.append(back)
            waiting -= left[back][2] - left[back][1]
            continue
        bin_, back = range(back - j, back), back - j
        free = capacity - sum(left[i][2] - left[i][1] for i in bin_)
        waiting -= capacity - free
        if free > waiting:
            loose += bin_  # too little is left to fill it with
            continue
        offset = 0
        for i in bin_:
            item, start, end = left[i]
            out.append((item, start, end - start, sequence, offset))
            offset += end - start
        while offset < capacity:
            item, start, length = cut(capacity - offset)
            out.append((item, start, length, sequence, offset))
            offset += length
        sequence += 1
    spans = [left[i] for i in reversed(loose)]
    total = sum(end - start for _, start, end in spans)
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    fill, offset = 0, 0
    for item, start, end in spans:
        while start < end:
            length = min(end - start, room[fill] - offset)
            out.append((item, start, length, sequence + fill, offset))
            start, offset = start + length, offset + length
            if offset == room[fill]:
                fill, offset = fill + 1, 0
    return out


def _packer(path: str, capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = Encoder(path), TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc_id, ids, sizes
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal base
            ids, size = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            pieces = pack_block(size.tolist(), capacity)
            item, start, length, sequence, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            stored = memoryview(ids.astype("<u4").view(np.uint8))
            at = (4 * ((np.cumsum(size) - size)[item] + start)).tolist()
            crc = [zlib.crc32(stored[a : a + 4 * n]) for a, n in zip(at, length.tolist(), strict=True)]
            doc_id = pa.concat_arrays([x[0] for x in held]).take(pa.array(item))
            out = frame(_SCHEMA, doc_id, start, length, np.array(crc, np.int64), size[item], base + sequence, offset)
            base += int(sequence.max(initial=-1)) + 1
            return out

        for batch in batches:
            for at, data, edge in text_groups(batch["text"]):
                ids, size = encoder.encode(data, edge)
                ended = np.full(len(ids) + len(size), END_ID, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
                held.append((batch["doc_id"].slice(at, len(size)), ended, size + 1))
                tokens += len(ended)
                if tokens >= block:
                    yield packed()
                    held, tokens = [], 0
        if held:
            yield packed()

    return run


def pack_harmonic(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per piece of the rows of ``docs`` (doc_id, text), as in _SCHEMA. ``path``: of a file that ``tokenizers`` reads, the
    same on all executors; ``capacity`` should be a power of two, else the last sequences of a block may be padded."""
    small_batches(docs.sparkSession, 4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packer(path or public_tokenizers.path(VOCABULARY), capacity, block), _SCHEMA)
