"""Harmonic packing: an exact round trip of ids, whole sequences, and the fixed counts of the classes."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cubespark.llm.harmonic_packing import pack_block, pack_harmonic
from cubespark.llm.tokens import Encoder
from tests.llm.conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def split(ids, size):
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def encode(encoder, texts):
    data = [t.encode() for t in texts]
    return split(*encoder.encode(b"".join(data), np.cumsum([0, *map(len, data)])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=80), st.sampled_from([8, 16, 64]))
def test_blocks_are_packed_whole(sizes, capacity):
    held, sequences = defaultdict(list), defaultdict(list)
    for item, start, length, sequence, offset in pack_block(sizes, capacity):
        assert length > 0
        held[item].append((start, length))
        sequences[sequence].append((offset, length))
    for spans, want in ((held, sizes), (sequences, None)):
        for k, v in spans.items():
            at = 0
            for start, length in sorted(v):
                assert start == at
                at += length
            assert at == want[k] if want else at == capacity or at.bit_count() == 1 and at < capacity
    assert sorted(held) == list(range(len(sizes))) and sorted(sequences) == list(range(len(sequences)))


def test_bins_of_a_class_hold_its_count():
    rng = random.Random(1)
    sizes = [rng.choice([300, 310, 330, 700, 900, 1500]) for _ in range(600)]
    bins = defaultdict(list)
    pieces = pack_block(sizes, 2048)
    for item, _, length, sequence, _ in pieces:
        bins[sequence].append((2048 // sizes[item], length == sizes[item]))
    counts = [max((sum(whole and c == j for c, whole in b), j) for j in {c for c, _ in b}) for b in bins.values()]
    assert sum(n == j for n, j in counts if j > 1) > 0.9 * sum(j > 1 and n > 0 for n, j in counts)
    assert len(pieces) < 1.6 * len(sizes)  # most documents stay whole


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "42", "é", "　", " ", "\u0085", "\x1c", "!?", "😀", "<|endoftext|>", "日本"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(2000)] + [prose(rng, 300), "", " "]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(PATH)
    assert encoder.ranked is not None
    assert encode(encoder, texts) == want
    assert encode(encoder, texts[::-1]) == want[::-1]  # with all chunks known
    encoder.ranked = None
    encoder._forget()
    assert encode(encoder, texts[:300]) == want[:300]  # by tokenizers alone


def test_forgotten_chunks_are_encoded_again(tokenizer, monkeypatch):
    from cubespark.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    rng = random.Random(5)
    texts, encoder = [prose(rng, 60) for _ in range(6)], Encoder(PATH)
    for _ in range(3):
        assert [encode(encoder, [t])[0] for t in texts] == [tokenizer.encode(t).ids for t in texts]
    assert len(encoder.known) < 200


@pytest.mark.parametrize("block", [1 << 22, 500])
def test_round_trip(make_docs, awkward, tokenizer, block):
    rng = random.Random(6)
    rows = [*awkward, *[(100 + i, prose(rng, rng.choice([1, 30, 400, 3000])), "s") for i in range(60)]]
    got = pack_harmonic(make_docs(rows).repartition(3), block=block).collect()
    ids = sorted((-1 if d is None else d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, _ in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[-1 if r.doc_id is None else r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at.bit_count() == 1
    for doc, own in ids:
        held = pieces[doc, len(own)]
        held.sort(key=lambda r: r.start)
        at, n = 0, 0
        while at < len(own):  # repeated rows have the same pieces or others; each is found once
            r = next(r for r in held if r.start == at and r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes()))
            held.remove(r)
            at, n = at + r.length, n + 1
    assert not any(pieces.values())


def test_empty_table(make_docs):
    assert pack_harmonic(make_docs([])).count() == 0
