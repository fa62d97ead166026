"""Secrets in texts: an Aho-Corasick pass finds keywords, anchored expressions run only at its hits, checksums decide.

Kinds, in the order used where spans start together:
  assign  a named value: password, passwd, secret, token, apikey or api_key, an equals sign or colon, 12 characters or more
  access  AKIA and capitals or digits, 18 characters or more
  hex     a run of 16 or more lower-case hexadecimal digits
  forge   gh, one of "pousr", _ and 36 letters or digits, the last six of which are the CRC-32 of the 30 before, in base 62
  pkgtok  npm_ and the same form and checksum
  jwt     three base64url parts, the first of which decodes to a JSON object with "alg"
  pem     a private-key block, to its end line if it has one
Expressions run on the UTF-8 bytes, where every one of them is plain ASCII; spans are given in code points, end exclusive.
A run of hexadecimal digits has no keyword of its own: bytes are mapped to their class first, and the keyword is 16 digits.

Every scan takes time in proportion to the text: what a failed match has read isn't read again for its kind, and the end lines of
key blocks are looked up once a text. A JSON head that is nested too deeply to be read is no JSON object.

Cases: a null or empty text has no secrets. Each row is scanned by itself and whole, however long; repeated rows give repeated
results, a null id stays null, an empty table gives an empty result, and other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import keyed_texts, small_batches, with_long

KINDS = ("assign", "access", "hex", "forge", "pkgtok", "jwt", "pem")
BASE = 3
MASK = "[SECRET]"

_ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_FORGE = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_PKG = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_PART = re.compile(rb"[A-Za-z0-9_-]+")
_PEM = re.compile(rb"-----BEGIN ([A-Z ]++)-----")
_PEM_END = re.compile(rb"-----END ([A-Z ]*+)-----")

#: Keywords in lower case, with the kind whose expression is tried at a hit.
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge",
    "npm_": "pkgtok", "eyj": "jwt", "-----begin ": "pem",
}
_DIGITS = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(".") for i in range(256))
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def base62_crc(body: bytes) -> bytes:
    """The CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body), []
    for _ in range(6):
        n, r = divmod(n, 62)
        out.append(_BASE62[r])
    return bytes(reversed(out))


def _is_jwt(head: bytes) -> bool:
    try:
        said = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(said, dict) and "alg" in said


def _jwt(data: bytes, at: int) -> tuple[int, bool]:
    if (end := _PART.match(data, at).end()) - at < 4:
        return end, False
    middle = _PART.match(data, end + 1) if data[end : end + 1] == b"." else None
    last = _PART.match(data, middle.end() + 1) if middle and data[middle.end() : middle.end() + 1] == b"." else None
    return (last.end(), _is_jwt(data[at:end])) if last else (end, False)  # whatever begins within the first part fails as well


class _Text:
    """The bytes of a text and, once they are asked for, its end lines of key blocks."""

    def __init__(self, data: bytes):
        self.data = data

    @functools.cached_property
    def pem_ends(self) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for m in _PEM_END.finditer(self.data):
            out.setdefault(m[1], []).append(m.start())
        return out

    def pem(self, at: int) -> tuple[int, bool] | None:
        if not (m := _PEM.match(self.data, at)) or not m[1].endswith(b"PRIVATE KEY"):
            return None
        ends = self.pem_ends.get(m[1], [])
        k = bisect.bisect_left(ends, m.end())
        return (ends[k] + len(m[1]) + 14 if k < len(ends) else m.end()), True

    def match(self, kind: str, at: int) -> tuple[int, bool] | None:
        """The end of the kind's match at a byte and whether it counts; a match that doesn't count still takes its place."""
        data = self.data
        if kind == "assign":
            return (m.end(), len(m[2]) >= 12) if (m := _ASSIGN.match(data, at)) else None
        if kind == "access":
            return (m.end(), m.end() - at >= 18) if (m := _ACCESS.match(data, at)) else None
        if kind == "jwt":
            return _jwt(data, at) if data.startswith(b"eyJ", at) else None
        if kind == "pem":
            return self.pem(at)
        m = (_FORGE if kind == "forge" else _PKG).match(data, at)
        return (m.end(), base62_crc(m[1]) == m[2]) if m else None


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    data = (text or "").encode("utf-8", "replace")
    whole = _Text(data)
    found, taken = [], dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _automaton().iter(data.lower().decode("latin-1")):
        at = last + 1 - length
        if at >= taken[kind] and (m := whole.match(kind, at)):
            taken[kind] = m[0]
            if m[1]:
                found.append((at, KINDS.index(kind), m[0]))
    classes, at = data.translate(_DIGITS), 0
    while (at := classes.find(b"h" * 16, at)) >= 0:
        end = _HEX.match(data, at).end()
        found.append((at, KINDS.index("hex"), end))
        at = end
    if not found:
        return []
    point = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(KINDS[k], int(point[a]), int(point[b])) for a, k, b in sorted(found)]


def redact(text: str | None) -> str | None:
    """The text with MASK in place of each run of overlapping secrets; the same object where there are none."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = find_secrets(text)
            counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS[:BASE]]
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in KINDS[:BASE])
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
        frame = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        frame.insert(0, "doc_id", batch["doc_id"])
        yield frame


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base kinds, the digest of their spans, and all spans."""
    small_batches(docs.sparkSession)
    schema = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return with_long(keyed_texts(docs).mapInPandas(_scan, schema), "doc_id")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked; n_chars, where there is one, follows in the rows that change."""
    small_batches(docs.sparkSession)
    masked = F.pandas_udf(lambda texts: texts.map(redact), "string")(F.col("text"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), masked.alias("_masked"))  # a struct, so that no name clashes
    changed = ~F.col("_masked").eqNullSafe(F.col("_row.text"))
    columns = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        n = F.when(changed, F.length("_masked")).otherwise(F.col("_row.n_chars"))
        columns["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
