"""Token ids of many texts at once by a byte-level BPE file of ``tokenizers``, exact and faster than a call for each text.

Byte-level BPE first splits a text by PATTERN, and a space or line break right before another character always begins a part of
its own there, whatever stands before it. So a text is cut at such places into chunks (a word with what clings to it), every
distinct chunk is encoded once, and the ids are put together again. Chunks are known by 64-bit hashes; a worker remembers the ids of
up to REMEMBERED of them, then starts afresh. Merges in the order of ids are what ``tiktoken`` applies, so it encodes the chunks if
the file has that order; texts that hold a special token's string, and all chunks of other files, go to ``tokenizers``.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from cubespark.llm.common import hashed_words

# Fixed value: how byte-level BPE of this family splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

REMEMBERED = 1 << 21
#: First bytes of characters that surely aren't white space: other characters don't begin a chunk, which is then longer but as exact.
_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = _SURE[0xC3:0xE1] = _SURE[0xE4:0xF5] = True
#: Spaces weigh nothing in the hash, so in chunks they stand as bytes that UTF-8 never has.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[[32, 9, 10, 11, 12, 13]] = range(0xF8, 0xFE)


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path: str) -> tiktoken.Encoding | None:
    """The file's merges as ranks; None unless they are byte-level, split by PATTERN, and in the order of ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, byte = spec["model"], spec["pre_tokenizer"] or {}, _bytes_of_symbols()
    if model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made = [model["vocab"]["".join(x)] for x in pairs]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if made != sorted(made) or len(ranks) != 256 + len(made) or any(ranks[bytes([b])] >= made[0] for b in range(256)):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Of one worker: what it has encoded stays known to it."""

    def __init__(self, path: str):
        self.tokenizer, self.ranked = Tokenizer.from_file(path), _ranked(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, chunk: str) -> list[int]:
        if self.ranked is None or any(s in chunk for s in self.special):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(chunk)

    def _learn(self, data: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        ids = [self._encode(data[a:b].decode("utf-8", "replace")) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))))
        place = np.arange(len(ids)) + len(self.begin) - 1
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(size)))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], np.concatenate((self.place, place))[order]

    def encode(self, data: bytes, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts ``data[edge[i] : edge[i + 1]]`` one after another, and how many each has."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(edge) - 1, np.int64)
        sure = np.append(_SURE[raw[1:]], False)
        sure[edge[1:][edge[1:] > 0] - 1] = False  # what follows is another text
        line = (raw == 10) & sure
        cut = np.zeros(len(raw) + 1, bool)
        cut[:-1] = ((raw == 32) & sure) | line
        cut[1:] |= line
        for special in self.special:  # the rest of such a text is split at it, white space before it too: the text is one chunk
            at = data.find(special.encode())
            while at >= 0:
                text = int(np.searchsorted(edge, at, "right"))
                cut[edge[text - 1] : edge[text]] = False
                at = data.find(special.encode(), int(edge[text]))
        cut[edge] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(raw))
        hashes = hashed_words(_SEEN[raw], start, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.append(self.known, np.uint64(0))[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(data, start[first[new]], end[first[new]], distinct[new])
            at = np.searchsorted(self.known, distinct)
        place = self.place[at][which]
        size = self.begin[place + 1] - self.begin[place]
        to = np.cumsum(size)
        ids = self.ids[np.arange(to[-1]) + np.repeat(self.begin[place] - to + size, size)]
        total = np.concatenate(([0], to))
        return ids, np.diff(total[np.searchsorted(start, edge)])
