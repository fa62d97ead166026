"""MPEG audio columns: texts as the main data of MPEG-1 Layer III frames, and a parser of MPEG audio streams.

Storing. A text in UTF-8, padded with zero bytes to a positive multiple of 64, is the payload. It fills the main data of
constant-format frames (one bit rate per frame, chosen so that the last frame is as small as it can be), behind an ID3v2 tag
that carries the payload's length and an information frame with a variable-bit-rate table. Every frame has a CRC-16 over
its header and side information. The unit of the format is the byte of main data: the payload is read back exactly. The stream is
stored as a column, beside its samples and sample rate (the exact duration is their quotient) and the byte offset of every frame.

Parsing works on any byte string with frames of MPEG-1, 2 and 2.5, Layers I to III, stereo or mono. It reads ID3v2 tags (2.2 to 2.4)
and an ID3v1 tag at the end, and takes a frame header if its CRC is right, or if another header of the same kind, a tag or the end
follows; other bytes are skipped, so it resynchronises after junk. It reads Xing, Info and VBRI tables, checks the CRC of every
protected frame and sums up samples, so durations are exact fractions. Frames of free bit rate have no length of their own and
count as junk.

Cases: a null text is an empty one. Each row stands for itself: equal texts give equal values, repeated rows and ids repeat them, a
null id stays null, an empty table gives an empty result, other columns, whatever their names, don't matter. A very long text is one
stream; its task holds a few times its bytes.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import keyed_texts, small_batches, stash, with_long

# Fixed values of ISO 11172-3 and 13818-3. Kbit/s by index, for (MPEG-1 or not, layer); index 0 is the free bit rate.
BIT_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Samples a second by index, for MPEG-1; MPEG-2 has half of it and MPEG-2.5 a quarter.
SAMPLE_RATES = (44100, 48000, 32000)
# Layer II: bits of each subband's allocation, as (bits, subbands), for high rates, 48 kHz or middle rates, low rates, low rates at
# 32 kHz, and MPEG-2.
LAYER_2_BITS = (
    ((4, 11), (3, 12), (2, 7)), ((4, 11), (3, 12), (2, 4)), ((4, 2), (3, 6)), ((4, 2), (3, 10)), ((4, 4), (3, 7), (2, 19)),
)
SAMPLES = 1152
SIDE_BYTES = 32
HEAD_BYTES = 4 + 2 + SIDE_BYTES
_RATE = 2  # 32 kHz: a frame has 36 * kbit/s * 1000 / 8 / 1000 bytes, a whole number
_TOC = 100


class Header(NamedTuple):
    version: float  # 1, 2 or 2.5
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    bound: int  # the first subband that both channels share (Layers I and II), 32 if none
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


def header(data: bytes, at: int) -> Header | None:
    """The frame header at a byte, if there is one."""
    return _header(data[at : at + 4]) if at + 4 <= len(data) else None


@functools.lru_cache(1 << 14)
def _header(four: bytes) -> Header | None:
    _, b, c, d = four
    version, layer = (2.5, None, 2, 1)[b >> 3 & 3], (None, 3, 2, 1)[b >> 1 & 3]
    if four[0] != 0xFF or b & 0xE0 != 0xE0 or version is None or layer is None or not 0 < c >> 4 < 15 or c >> 2 & 3 == 3:
        return None
    kbits = BIT_RATES[version == 1, layer][c >> 4]
    rate = SAMPLE_RATES[c >> 2 & 3] >> (0, 1, 2)[(1, 2, 2.5).index(version)]
    half = layer == 3 and version != 1
    size = (12 * kbits * 1000 // rate + (c >> 1 & 1)) * 4 if layer == 1 else (72 if half else 144) * kbits * 1000 // rate + (c >> 1 & 1)
    bound = 4 * (d >> 4 & 3) + 4 if d >> 6 == 1 and layer < 3 else 32
    return Header(version, layer, not b & 1, kbits, rate, d >> 6 == 3, bound, size, 384 if layer == 1 else 576 if half else 1152)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@functools.lru_cache(1 << 12)
def crc16(data: bytes) -> int:
    """The CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for b in data:
        c = (c << 8) & 0xFFFF ^ _CRC[(c >> 8) ^ b]
    return c


def _crc_bits(data: bytes, bits: int) -> int:
    """The CRC-16 of the header's last two bytes and ``bits`` bits behind the CRC field of a frame."""
    body = data[6:]
    c = crc16(data[2:4] + body[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = body[k // 8] >> 7 - k % 8 & 1
        c = (c << 1) & 0xFFFF ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


def _checked_bits(head: Header, frame: bytes) -> int:
    """The bits behind the CRC field that a protected frame's CRC covers."""
    if head.layer == 3:
        return 8 * head.side
    channels = 1 if head.mono else 2
    if head.layer == 1:
        return 4 * (32 if head.mono else 32 + head.bound)
    each = head.kbits // channels
    if head.version != 1:
        table = 4
    elif head.rate == 48000:
        table = 1 if each >= 56 else 2
    else:
        table = 2 + (head.rate == 32000) if each < 56 else 1 if each <= 80 else 0
    at, used = 0, 0
    number = int.from_bytes(frame[6:], "big")
    total = 8 * (len(frame) - 6)
    for band, width in enumerate(w for w, n in LAYER_2_BITS[table] for _ in range(n)):
        shared = channels == 2 and band >= head.bound
        for _ in range(1 if shared else channels):
            used += (channels if shared else 1) * bool(number >> max(0, total - at - width) & (1 << width) - 1)
            at += width
    return at + 2 * used


def _sound(head: Header, frame: bytes) -> bool:
    """Whether a protected frame's CRC is right."""
    bits = _checked_bits(head, frame)
    return 6 + -(-bits // 8) <= len(frame) and _crc_bits(frame, bits) == int.from_bytes(frame[4:6], "big")


def frame_bytes(bit_index: int) -> int:
    return 144 * BIT_RATES[True, 3][bit_index] * 1000 // SAMPLE_RATES[_RATE]


def _frame_head(bit_index: int) -> bytes:
    """Header, CRC and empty side information of a protected stereo frame."""
    head = bytes((0xFF, 0xFA, bit_index << 4 | _RATE << 2, 0x00))
    side = bytes(SIDE_BYTES)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_HEADS = [_frame_head(i) if i else b"" for i in range(len(BIT_RATES[True, 3]))]
_ROOM = [frame_bytes(i) - HEAD_BYTES if i else 0 for i in range(len(BIT_RATES[True, 3]))]
_TOP = len(BIT_RATES[True, 3]) - 1


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), len(data)


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _field(name: str, value: int) -> bytes:
    said = f"\0{name}\0{value}".encode()
    return b"TXXX" + len(said).to_bytes(4, "big") + b"\0\0" + said


def encode(payload: bytes, unpadded: int | None = None) -> bytes:
    """An ID3v2 tag with the payload's length and that before padding, the information frame, and frames that hold ``payload``."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index = next((i for i in range(1, _TOP) if _ROOM[i] >= left), _TOP)
        part = payload[at : at + _ROOM[index]]
        frames.append(_HEADS[index] + part.ljust(_ROOM[index], b"\0"))
        at += len(part)
    sizes = np.cumsum([0, *map(len, frames)])
    toc = bytes(int(sizes[i * len(frames) // _TOC] * 256 // max(1, sizes[-1])) for i in range(_TOC))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + int(sizes[-1]).to_bytes(4, "big") + toc
    info = _HEADS[9] + table
    info = info.ljust(frame_bytes(9), b"\0")
    tag = _field("payload", len(payload)) + _field("bytes", len(payload) if unpadded is None else unpadded)
    return b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag + info + b"".join(frames)


def _size(four: bytes, safe: bool) -> int:
    return sum((b & 0x7F) << s for b, s in zip(four, (21, 14, 7, 0), strict=True)) if safe else int.from_bytes(four, "big")


def _said(data: bytes) -> tuple[str, str]:
    """Name and value of a user text field."""
    coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[data[0] if data and data[0] < 4 else 0]
    name, _, value = data[1:].decode(coding, "replace").partition("\0")
    return name, value.strip("\0\ufeff")


def _tags(data: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """The end of an ID3v2 tag at a byte, and its user text fields; the byte itself where there is none."""
    head = data[at : at + 10]
    if head[:3] != b"ID3" or len(head) < 10 or head[3] not in (2, 3, 4) or max(head[6:10]) > 0x7F:
        return at, {}
    version, flags = head[3], head[5]
    end = min(at + 10 + _size(head[6:10], True) + 10 * bool(version == 4 and flags & 0x10), len(data))
    body, place, out = data[at + 10 : end], 0, {}
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and version > 2:
        place = _size(body[:4].ljust(4, b"\0"), version == 4) + 4 * (version == 3)
    wide, name = (6, b"TXX") if version == 2 else (10, b"TXXX")
    while place + wide <= len(body) and body[place : place + len(name)].strip(b"\0"):
        field = body[place : place + wide]
        size = int.from_bytes(field[3:6], "big") if version == 2 else _size(field[4:8], version == 4)
        if field[: len(name)] == name:
            key, value = _said(body[place + wide : place + wide + size])
            out[key] = value
        place += wide + size
    return end, out


def _last_tag(data: bytes) -> dict[str, str]:
    """The fields of an ID3v1 tag, the last 128 bytes."""
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return {}
    places = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}
    return {name: tag[a:b].split(b"\0")[0].decode("latin-1").rstrip() for name, (a, b) in places.items()}


def _table(head: Header, frame: bytes) -> dict | None:
    """The variable-bit-rate table of an information frame."""
    place = 4 + 2 * head.protected + head.side
    if frame[place : place + 4] in (b"Xing", b"Info"):
        flags, out = int.from_bytes(frame[place + 4 : place + 8], "big"), {}
        place += 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[place : place + 4], "big")
                place += 4
        if flags & 4:
            out["toc"] = frame[place : place + _TOC]
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, n, scale, width, step = (int.from_bytes(frame[a:b], "big") for a, b in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60), (60, 62)))
        toc = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(n)]
        return {"frames": frames, "bytes": size, "toc": toc, "frames_per_entry": step}
    return None


def parse(data: bytes) -> dict:
    """What a stream holds: tags, the table, frames with their offsets, CRC errors, skipped bytes, samples by rate, main data (Layer
    III) or the bytes behind header and CRC (Layers I and II), and the exact duration in seconds."""
    at, tags = _tags(data)
    last = _last_tag(data[at:])
    stop = len(data) - 128 * bool(last)
    offsets, main, skipped, wrong, samples, table, first = [], [], 0, 0, {}, None, True
    while at < stop:
        head = header(data, at)
        good = follows = False
        if head and at + head.size <= stop:  # a header in junk has neither a right CRC nor another header, or the end, behind it
            frame, to = data[at : at + head.size], at + head.size
            good = head.protected and _sound(head, frame)
            after = header(data, to)
            follows = to == stop or data[to : to + 3] == b"ID3" or after is not None and after.kind == head.kind
        if not good and not follows:
            to, more = _tags(data, at)
            if to > at:
                tags |= more
                at = min(to, stop)
                continue
            near = [x for x in (data.find(b"\xff", at + 1, stop), data.find(b"ID3", at + 1, stop)) if x >= 0]
            to = min(near, default=stop)
            skipped, at = skipped + to - at, to
            continue
        wrong += head.protected and not good
        said = _table(head, frame) if first and head.layer == 3 else None
        if said is not None:
            table = said
        else:
            offsets.append(at)
            samples[head.rate] = samples.get(head.rate, 0) + head.samples
            main.append(frame[4 + 2 * head.protected + head.side * (head.layer == 3) :])
        first, at = False, to
    duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    return {
        "tags": tags, "id3v1": last, "table": table, "offsets": offsets, "crc_errors": wrong, "skipped": skipped, "samples": samples,
        "duration": duration, "main": b"".join(main),
    }


def stored(text: str | None) -> tuple[bytes, int, int, list[int]]:
    """The stored form of a text: the stream, its samples, samples a second, and frame offsets."""
    payload, n = payload_of(text)
    media = encode(payload, n)
    at = 10 + _size(media[6:10], True) + frame_bytes(9)
    full, rest = divmod(len(payload), _ROOM[_TOP])
    offsets = list(range(at, at + full * frame_bytes(_TOP), frame_bytes(_TOP))) + [at + full * frame_bytes(_TOP)] * bool(rest)
    return media, SAMPLES * len(offsets), SAMPLE_RATES[_RATE], offsets


def read(media: bytes, samples: int, rate: int, offsets: list[int]) -> tuple:
    """The digest columns of a stored stream."""
    seen = parse(media)
    back = seen["main"][: int(seen["tags"]["payload"])]
    n = int(seen["tags"]["bytes"])
    table = seen["table"]
    agrees = table["frames"] == len(seen["offsets"]) and table["bytes"] == len(media) - seen["offsets"][0]
    seeks = seen["offsets"] == list(offsets) and seen["duration"] == Fraction(samples, rate)
    said = (
        f"rate={rate};samples={samples};duration_us={samples * 1_000_000 // rate};frames={len(offsets)};"
        f"crc_errors={seen['crc_errors']};skipped={seen['skipped']};table={'ok' if agrees else 'differs'};"
        f"seek={hashlib.sha256(','.join(map(str, offsets)).encode()).hexdigest()[:16] if seeks else 'differs'}"
    )
    return (
        n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), said,
        samples, rate, list(offsets),
    )


def feature(text: str | None) -> tuple:
    """The digest columns of one text."""
    return read(*stored(text))


_COLUMNS = (
    "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "sample_rate", "frame_offsets",
)
_STORED = ("media", "samples", "sample_rate", "frame_offsets")


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        frame = pd.DataFrame([stored(text) for text in batch["text"]], columns=list(_STORED))
        frame.insert(0, "doc_id", batch["doc_id"])
        yield frame


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = zip(*(batch[c] for c in _STORED), strict=True)
        frame = pd.DataFrame([read(bytes(m), s, r, o.tolist()) for m, s, r, o in rows], columns=list(_COLUMNS))
        frame.insert(0, "doc_id", batch["doc_id"])
        yield frame


def media_columns(docs: DataFrame) -> DataFrame:
    """The stored form of each row of ``docs`` (doc_id, text): media binary, samples, sample_rate, frame_offsets."""
    small_batches(docs.sparkSession)
    schema = "doc_id string, media binary, samples long, sample_rate long, frame_offsets array<long>"
    return with_long(keyed_texts(docs).mapInPandas(_streams, schema), "doc_id")


def media_features(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the digests and features read back from its stored stream, and the stored samples,
    sample rate and frame offsets."""
    media = stash(media_columns(docs)).withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = (
        "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, samples long, sample_rate long, frame_offsets array<long>"
    )
    return with_long(media.mapInPandas(_features, schema), "doc_id")
