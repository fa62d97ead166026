"""WARC archives: round trip, framing, digests and damage."""

from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from cubespark.llm.warc import file_system, members, parse, read_archives, record, write_archives


def brute(pages: list[tuple]) -> list[tuple]:
    top = {}
    for page, _, html in pages:
        data = (html or "").encode()
        top.setdefault(data, []).append(page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        known = [p for p in top[data] if p is not None]
        first = max(known) if len(data) >= 1000 and len(top[data]) > 1 and known else None
        revisit = first is not None and page != first
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, ex = "é" * 600, "x" * 1000
    pages = [(1, "http://a\r\nX: y", big), (2, None, big), (3, "u", ex), (3, "u", ex), (4, "u", ex), (5, "u", "x" * 999), (6, "u", "x" * 999)]
    pages += [(7, "u", None), (8, "u", ""), (None, "u", ex), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (10, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, path string")
    archives = write_archives(df)
    got = read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages)
    assert sum(r.records for r in archives.collect()) == len(pages)
    for a in archives.collect():  # any gzip reader takes the archive as a whole
        assert gzip.open(a.path.removeprefix("file://")).read().count(b"WARC-Type") == a.records
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_damage_is_found():
    one, two = record(1, "u", b"abc", None, False), record(2, "u", b"def" * 500, None, False)
    found = list(members(io.BytesIO(one + two)))
    assert [o for o, _ in found] == [0, len(one)] and parse(found[1][1])["payload_bytes"] == 1500
    with pytest.raises(ValueError, match="cut"):
        list(members(io.BytesIO(one + two[:-20])))
    with pytest.raises(ValueError, match="digest"):
        parse(found[0][1].replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="framed"):
        parse(found[0][1][:-4])
    with pytest.raises(ValueError, match="damaged"):
        list(members(io.BytesIO(one[:30] + b"\xff\xff\xff\xff" + one[34:])))


def test_schemes_of_hadoop_are_known(tmp_path):
    assert file_system(f"file://{tmp_path}")[1] == str(tmp_path)
    store, path = file_system("s3a://bucket/some/key?region=us-east-1")
    assert store.type_name == "s3" and path == "bucket/some/key"
