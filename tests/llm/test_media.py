"""MPEG audio: exact round trips, resynchronisation, checksums, tables."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubespark.llm.media import SAMPLES, crc16, encode, feature, media_columns, media_features, parse, payload_of


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=6000))
def test_round_trip(data):
    payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    seen = parse(encode(payload))
    assert seen["main"][: int(seen["tags"]["payload"])] == payload
    assert seen["crc_errors"] == 0 and seen["skipped"] == 0 and seen["table"]["frames"] == len(seen["offsets"])


def test_payload_that_looks_like_headers():
    payload = b"\xff\xfa\xe8\x00" * 1600
    seen = parse(encode(payload))
    assert seen["main"][: len(payload)] == payload and seen["skipped"] == 0


def test_junk_is_skipped_and_flipped_bits_are_found():
    payload = bytes(range(256)) * 40
    media = encode(payload)
    clean = parse(media)
    at = clean["offsets"][2]
    dirty = parse(media[:at] + b"\xff\xfa junk \xff" + media[at:])
    assert dirty["skipped"] == 9 and len(dirty["offsets"]) == len(clean["offsets"]) and dirty["main"] == clean["main"]
    flipped = bytearray(media)
    flipped[at + 10] ^= 1
    assert parse(bytes(flipped))["crc_errors"] == 1
    assert clean["samples"] == {32000: SAMPLES * len(clean["offsets"])}
    assert parse(b"")["offsets"] == [] and parse(b"\xff" * 50)["skipped"] == 50
    assert crc16(b"123456789") == 0xAEE7


def test_rows(make_docs, awkward):
    got = {(r.doc_id, r.n_bytes): r for r in media_features(make_docs(awkward)).collect()}
    for d, text, _ in awkward:
        payload, n = payload_of(text)
        r = got[(d, n)]
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and "crc_errors=0;skipped=0;table=ok" in r.feature
        assert tuple(r)[1:] == feature(text)
    stored = media_columns(make_docs(awkward)).collect()
    assert len(stored) == len(awkward) and all(parse(bytes(r.media))["offsets"] == r.frame_offsets for r in stored)
    assert media_features(make_docs(awkward).limit(0)).count() == 0


def bit_crc(bits: str) -> int:
    """CRC-16 a bit at a time."""
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ int(b) else 0)) & 0xFFFF
    return c


def frame(second: int, third: int, fourth: int, size: int, covered: int, body: bytes = b"") -> bytes:
    """A frame made by hand: header bytes behind 0xFF, its size in bytes, and the bits that its CRC covers."""
    head = bytes((0xFF, second, third, fourth))
    if second & 1:
        return (head + body).ljust(size, b"\0")
    rest = body.ljust(size - 6, b"\0")
    bits = "".join(f"{b:08b}" for b in head[2:] + rest)[: 16 + covered]
    return head + bit_crc(bits).to_bytes(2, "big") + rest


# (header bytes, frame bytes, covered bits, samples, samples a second), from the tables of the standard
KINDS = {
    "MPEG-1 III 128k 44.1 stereo": ((0xFA, 0x90, 0x00), 417, 256, 1152, 44100),
    "MPEG-1 III 128k 44.1 mono padded": ((0xFA, 0x92, 0xC0), 418, 136, 1152, 44100),
    "MPEG-2 III 64k 22.05 stereo": ((0xF2, 0x80, 0x00), 208, 136, 576, 22050),
    "MPEG-2 III 64k 22.05 mono": ((0xF2, 0x80, 0xC0), 208, 72, 576, 22050),
    "MPEG-2.5 III 16k 8 mono": ((0xE2, 0x28, 0xC0), 144, 72, 576, 8000),
    "MPEG-1 I 384k 48 stereo": ((0xFE, 0xC4, 0x00), 384, 256, 384, 48000),
    "MPEG-1 I 192k 48 joint, bound 8": ((0xFE, 0x64, 0x50), 192, 160, 384, 48000),
    "MPEG-1 II 192k 44.1 stereo": ((0xFC, 0xA0, 0x00), 626, 2 * (44 + 36 + 14), 1152, 44100),
    "MPEG-2 II 64k 24 mono": ((0xF4, 0x84, 0xC0), 384, 16 + 21 + 38, 1152, 24000),
}


@pytest.mark.parametrize("name", KINDS)
def test_streams_made_by_hand(name):
    head, size, covered, samples, rate = KINDS[name]
    one = frame(*head, size, covered)
    seen = parse(b"junk\xff\xfb\x90" + one * 3)
    assert seen["skipped"] == 7 and seen["crc_errors"] == 0 and seen["offsets"] == [7 + k * size for k in range(3)]
    assert seen["samples"] == {rate: 3 * samples} and seen["duration"] == Fraction(3 * samples, rate)
    bad = bytearray(one * 3)
    bad[size + 7] ^= 0x80
    assert parse(bytes(bad))["crc_errors"] == 1 and len(parse(bytes(bad))["offsets"]) == 3
    plain = frame(head[0] | 1, *head[1:], size, 0)
    assert parse(plain * 2)["crc_errors"] == 0 and parse(plain * 2)["offsets"] == [0, size]


def test_layer_2_scale_factors_are_covered():
    # 192 kbit/s, 44.1 kHz, stereo: 96 a channel, so four bits for each channel of the first band; both allocated
    one = frame(0xFC, 0xA0, 0x00, 626, 2 * (44 + 36 + 14) + 4, b"\x11" + bytes(22) + b"\x0f")
    assert parse(one * 2)["crc_errors"] == 0
    bad = bytearray(one * 2)
    bad[6 + 23] ^= 0x08  # within the last covered bits
    assert parse(bytes(bad))["crc_errors"] == 1


def test_tables_and_tags_made_by_hand():
    one = frame(0xFB, 0x90, 0x00, 417, 0)
    vbri = b"VBRI" + b"".join(n.to_bytes(w, "big") for n, w in ((1, 2), (0, 2), (75, 2), (5000, 4), (2, 4), (2, 2), (3, 2), (2, 2), (1, 2), (139, 2), (140, 2)))
    info = frame(0xFB, 0x90, 0x00, 417, 0, bytes(32) + vbri)
    old = b"TAG" + b"Title".ljust(30, b"\0") + b"Who".ljust(30) + bytes(30) + b"1999" + b"said".ljust(30, b"\0") + b"\x05"
    text = "\x03Key\0é".encode()
    new = b"ID3\x04\x00\x50" + bytes((0, 0, 1, 34))  # version 2.4 with an extended header and a footer; 162 bytes
    field = b"TXXX" + bytes((0, 0, 1, 10)) + b"\0\0" + text.ljust(138, b"\0")
    new += bytes((0, 0, 0, 6, 1, 0)) + field
    new = new.ljust(10 + 162, b"\0") + b"3DI\x04\x00\x50" + bytes((0, 0, 1, 34))
    two = b"ID3\x02\x00\x00" + bytes((0, 0, 0, 14)) + b"TXX" + bytes((0, 0, 8)) + b"\x00Old\0yes"
    seen = parse(new + info + one + one + two + one + old)
    assert seen["tags"] == {"Key": "é", "Old": "yes"} and seen["id3v1"] == {"title": "Title", "artist": "Who", "album": "", "year": "1999", "comment": "said"}
    assert seen["table"] == {"frames": 2, "bytes": 5000, "toc": [417, 420], "frames_per_entry": 1}
    assert seen["skipped"] == 0 and len(seen["offsets"]) == 3 and seen["offsets"][0] == len(new) + 417
    xing = frame(0xFB, 0x90, 0xC0, 417, 0, bytes(17) + b"Info" + (3).to_bytes(4, "big") + (9).to_bytes(4, "big") + (7777).to_bytes(4, "big"))
    assert parse(xing + frame(0xFB, 0x90, 0xC0, 417, 0))["table"] == {"frames": 9, "bytes": 7777}


def test_media_is_stored_and_read_back(make_docs):
    text = "é" * 5000
    (r,) = media_features(make_docs([(1, text, "s")])).collect()
    (m,) = media_columns(make_docs([(1, text, "s")])).collect()
    assert r.frame_offsets == m.frame_offsets == parse(bytes(m.media))["offsets"] and "seek=differs" not in r.feature
    assert (r.n_bytes, r.samples, r.sample_rate) == (10_000, m.samples, m.sample_rate) and r.media_sha256 == hashlib.sha256(m.media).hexdigest()
