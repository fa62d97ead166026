"""Words, lines and runs of words of many texts at once, for Arrow tasks: a step for each text would cost more than the text.

A group is a run of rows of an Arrow batch whose texts have at most GROUP_BYTES together, or one longer text. Words are split at
SPACE and compared without regard to the case of A-Z; lines are split at \\n. Nothing crosses from one text to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from cubespark.llm.common import hashed_words, is_space, mix

GROUP_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Group:
    """The texts ``data[edge[i] : edge[i + 1]]`` of rows ``at`` and following."""

    def __init__(self, at: int, data: bytes, edge: np.ndarray):
        self.at, self.edge, self.docs = at, edge, len(edge) - 1
        raw = np.frombuffer(data, np.uint8)
        space = is_space(raw)
        cut = np.zeros(len(raw) + 1, bool)
        cut[edge] = True
        inside = ~space
        starts = inside & (cut[:-1] | np.concatenate(([True], space[:-1])))
        ends = inside & (cut[1:] | np.concatenate((space[1:], [True])))
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.word = hashed_words(np.frombuffer(data.lower(), np.uint8), self.start, self.end)
        breaks = np.flatnonzero(raw == 10)
        self.line_start = np.sort(np.concatenate((edge[:-1], breaks + 1)))
        # A text's lines are numbered from its own first one; an empty text has one line as well.
        self.first_line = np.arange(self.docs) + np.searchsorted(breaks, edge[:-1])
        self.line_doc = np.repeat(np.arange(self.docs), np.diff(np.append(self.first_line, len(self.line_start))))
        follows = np.append(self.line_doc[1:] == self.line_doc[:-1], False)
        self.line_end = np.where(follows, np.append(self.line_start[1:], 0) - 1, edge[self.line_doc + 1])
        # Empty texts share their place with the next text. A word's line is the last that starts at or before it, so never theirs.
        self.line = np.searchsorted(self.line_start, self.start, "right") - 1
        self.doc = self.line_doc[self.line]
        self.point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80))) if len(raw) and raw.max() >= 0x80 else None

    def points(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Code points of byte places within their texts."""
        base = self.edge[doc]
        return at - base if self.point is None else self.point[at] - self.point[base]

    def paragraphs(self, least: int) -> np.ndarray:
        """The lines of ``least`` words or more."""
        return np.flatnonzero(np.bincount(self.line, minlength=len(self.line_start)) >= least)

    def spans_of_lines(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each line's first word, and how many it has."""
        first = np.searchsorted(self.line, lines)
        return first, np.searchsorted(self.line, lines, "right") - first

    def spans_of_texts(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's first word, and how many it has."""
        first = np.searchsorted(self.doc, np.arange(self.docs + 1))
        return first[:-1], np.diff(first)

    def shingles(self, first: np.ndarray, count: np.ndarray, width: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of each span of words, sorted within each, and where each span's begin. A span of fewer words is one
        shingle; every span must have a word. Shingles are known by 48 bits, or by 64 if ``wide``, which takes longer for short spans."""
        runs = np.maximum(count - width + 1, 1)
        owner = np.repeat(np.arange(len(runs)), runs)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
        h = self.word[at]
        size = np.repeat(count, runs) if (count < width).any() else None
        for k in range(1, width):
            more = self.word[np.minimum(at + k, len(self.word) - 1)]
            h = h * _BASE + (more if size is None else np.where(k < size, more, np.uint64(k)))
        h = mix(h)
        if wide:
            parts = [np.unique(x) for x in np.split(h, np.cumsum(runs)[:-1])] if len(runs) else []
            sizes = np.array([len(x) for x in parts], np.int64)
            return np.concatenate([h[:0], *parts]), np.cumsum(sizes) - sizes
        h >>= np.uint64(16)
        kept_h, kept_owner = [h[:0]], [owner[:0]]
        for lo in range(0, len(runs), 1 << 16):  # 16 bits hold the owner's number, so one sort does
            part = slice(*np.searchsorted(owner, [lo, lo + (1 << 16)]))
            key = np.unique(h[part] | ((owner[part] - lo).astype(np.uint64) << np.uint64(48)))
            kept_owner.append((key >> np.uint64(48)).astype(np.int64) + lo)
            kept_h.append(key << np.uint64(16))
        return np.concatenate(kept_h), np.flatnonzero(np.diff(np.concatenate(kept_owner), prepend=-1))

    def grams(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each ``run`` words in a row of one text, whatever lines they stand on, and the number of its first word."""
        h, width = self.word, 1
        if len(h) < run:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        while width < run:  # two that overlap, or meet, make a longer one
            step = min(width, run - width)
            h = mix(h[:-step] * _BASE + h[step:])
            width += step
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[run - 1 :])
        return h[at], at

    def seeds(self, gram: np.ndarray, at: np.ndarray, spread: int) -> np.ndarray:
        """Places in ``gram`` of those that are the least of ``spread`` in a row of their text, or of all of it where it has fewer."""
        if not len(gram):
            return np.zeros(0, np.int64)
        doc = self.doc[at]
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        count = np.diff(np.append(begin, len(doc)))
        least = np.repeat(np.minimum.reduceat(gram, begin), count)
        chosen = (gram == least) & np.repeat(count < spread, count)
        if len(gram) >= spread:
            low, high = gram, None
            width = 1
            while width < spread:
                step = min(width, spread - width)
                low = np.minimum(low[:-step], low[step:])
                width += step
            low = np.where(doc[: len(low)] == doc[spread - 1 :], low, np.uint64(0))
            high, width = np.concatenate((np.zeros(spread - 1, np.uint64), low, np.zeros(spread - 1, np.uint64))), 1
            while width < spread:
                step = min(width, spread - width)
                high = np.maximum(high[:-step], high[step:])
                width += step
            chosen |= (high == gram) & (gram > 0)
        return np.flatnonzero(chosen)


def text_groups(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """The runs of rows of an Arrow column of strings that make a group: the first row, the texts' bytes, and where each begins and
    the last ends. Null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + GROUP_BYTES, "right")) - 1)
        yield at, data[int(edges[at]) : int(edges[to])].to_pybytes() if data is not None else b"", edges[at : to + 1] - edges[at]
        at = to


def groups(texts: pa.Array) -> Iterator[Group]:
    """The groups of an Arrow column of strings; null is an empty text."""
    for at, data, edge in text_groups(texts):
        yield Group(at, data, edge)


def lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """An Arrow column of lists that lie one after another."""
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(values))


def frame(schema: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Columns under the names of a schema."""
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], [x.split()[0] for x in schema.split(", ")])


def arrow_task(task: Callable[[pa.RecordBatch, Group], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow that is called with each batch and each group of its column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch["text"]):
                yield from task(batch, group)

    return run
