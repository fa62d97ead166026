"""WARC archives: one gzip member per record, written by Spark tasks into the shared folder and read back in sequence.

Writing. A page's payload is its html in UTF-8. Of the pages with equal payloads of at least MIN_REVISIT bytes the one of
the largest page_id is a ``response``; the others become ``revisit`` records that keep the HTTP header and point to it.
Each task writes archives of about ARCHIVE_BYTES under a name of its own and renames them when they are complete; only the
names that successful tasks return are read, so a task that ran twice, or was lost, leaves nothing that counts.

Reading. A task streams an archive through zlib a block at a time, one decompressor per gzip member, so memory is bounded
by a record. A record's block is framed by its Content-Length; the block and payload digests are computed again and must
agree. A damaged member raises ValueError with its offset.

Cases: a null html is an empty payload. Rows that repeat the largest page_id of a group are all responses; other repeats
all revisit. A null page_id is smaller than any other. An empty table gives no archives and no rows. Other columns, whatever
their names, are not stored; a null url becomes a urn of the page.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import small_batches, stash
from cubespark.sources.store import shared_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
_BLOCK = 1 << 16
_WRITTEN = "path string, bytes long, records long"
_READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, url string"
)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    said = urn.strip("<>").rpartition(":")[2]
    return None if said == "none" else int(said)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = " ".join((url or "").split()) or _urn(page_id).strip("<>")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {_sha1(block)}", f"WARC-Payload-Digest: {_sha1(payload)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member, decompressed block by block."""
    unpacker, out, offset, at = zlib.decompressobj(31), [], 0, 0
    while block := stream.read(_BLOCK):
        while block:
            try:
                out.append(unpacker.decompress(block))
            except zlib.error as e:
                raise ValueError(f"damaged gzip member at byte {offset}: {e}") from e
            rest = unpacker.unused_data
            at += len(block) - len(rest)
            if unpacker.eof:
                yield offset, b"".join(out)
                unpacker, out, offset = zlib.decompressobj(31), [], at
            block = rest
    if at > offset:
        raise ValueError(f"cut gzip member at byte {offset}")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse(content: bytes) -> dict:
    """A record's fields, framed by Content-Length and checked against its digests."""
    head, gap, body = content.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    warc = _fields(head)
    size = int(warc["content-length"])
    block = body[:size]
    if len(block) < size or body[size:] != b"\r\n\r\n":
        raise ValueError("the block is not framed by its Content-Length")
    if _sha1(block) != warc["warc-block-digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_fields(http)["content-length"])
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or _sha1(payload) != warc["warc-payload-digest"]):
        raise ValueError("payload digest differs")
    return {
        "page_id": _page(warc["warc-record-id"]),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex(),
        "record_type": warc["warc-type"],
        "refers_to": _page(warc["warc-refers-to"]) if revisit else None,
        "url": warc["warc-target-uri"],
    }


# Schemes of Hadoop's file systems, and those under which pyarrow knows the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def _writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        size = n = 0
        done = []

        def close() -> None:
            nonlocal out
            out.close()
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            done.append((f"{folder}/{name}", size, n))
            out = None

        for batch in batches:
            for page_id, url, html, revisit, refers_to in batch.itertuples(index=False, name=None):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}.part", compression=None)
                ids = [None if x is None else int(x) for x in (page_id, refers_to)]
                member = record(ids[0], url, (html or "").encode("utf-8", "replace"), ids[1], bool(revisit))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    return run


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            store, name = file_system(path)
            rows = []
            with store.open_input_stream(name, compression=None) as stream:
                for offset, content in members(stream):
                    rows.append(parse(content) | {"path": path, "offset": offset})
                    if len(rows) >= 2000:
                        yield _records(rows)
                        rows = []
            if rows:
                yield _records(rows)


def _records(rows: list[dict]) -> pd.DataFrame:
    columns = {c: [r[c] for r in rows] for c in (x.split()[0] for x in _READ.split(", "))}
    exact = {c: pd.array(columns[c], dtype="Int64") for c in ("page_id", "refers_to")}  # a frame would make floats beside nulls
    return pd.DataFrame(columns | exact)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; one row per archive: path, bytes, records.

    ``folder`` is a URI that every executor reaches; by default one of its own below the session's shared folder.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_path(spark, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("_key"), F.length(payload).alias("_size"))
    # Only large payloads are compared; the others, empty ones above all, are no group and aren't shuffled.
    large, small = rows.where(F.col("_size") >= MIN_REVISIT), rows.where(F.col("_size") < MIN_REVISIT)
    groups = large.groupBy("_key").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    placed = large.join(groups.hint("merge"), "_key", "left").unionByName(small, allowMissingColumns=True)
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    ids = [c.cast("string") for c in (F.col("page_id"), F.when(revisit, F.col("_first")))]  # exact in pandas, nulls or not
    out = placed.select(ids[0].alias("page_id"), "url", "html", revisit.alias("revisit"), ids[1].alias("refers_to"))
    return stash(out.mapInPandas(_writer(folder), _WRITTEN))


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of ``archives`` (path), one task per archive or so."""
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInPandas(_reader, _READ)
