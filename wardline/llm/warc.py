"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. Readers get byte ranges, not files: a task looks for gzip's magic bytes
from the start of its range, accepts a candidate only if the bytes behind it inflate to a WARC header, then walks
from member to member, and owns the records that start inside its range (the last may end beyond it).
Archives are written and read through ``pyarrow.fs``, so any URI it knows (file, hdfs, s3, gs) can hold them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.storage import materialise, new_path

MAGIC = b"\x1f\x8b\x08"
RECORD_ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary, path string, position long"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(kind: str, fields: dict[str, str | None], block: bytes, level: int) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str, level: int) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": f"<{RECORD_ID}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is None:
        return _member("response", fields, http + payload, level)
    return _member("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{RECORD_ID}{refers_to}>"}, http, level)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of ``least_bytes`` or more, the largest page_id is the response.

    Digests are compared in the JVM; the join's sides both end in a shuffle, so a payload that a third of all
    pages share is split. Rows that repeat the response's page_id are responses as well.
    """
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    first = keyed.groupBy("digest").agg(F.max("page_id").alias("first")).select(F.lower("digest").alias("digest"), "first")
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    other = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(first, "digest").select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write_warc(rows: DataFrame, folder: str, file_bytes: int = 256 << 20, level: int = 4, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write rows of ``with_revisits`` as archives in ``folder`` (a URI); returns the written (path, size) table.

    A file belongs to one task attempt and only files of finished tasks are listed, so a task that runs again
    leaves an unlisted file at worst.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, name = None, [], ""
        for b in batches:
            for page_id, url, html, refers in zip(b["page_id"].astype("Int64"), b["url"], b["html"], b["refers_to"].astype("Int64")):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(_member("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", level))
                text = lambda v: None if v is None or v is pd.NA or v != v else v
                out.write(_record(text(page_id) if page_id is not pd.NA else None, text(url), text(html), None if refers is pd.NA else refers, date, level))
                if out.tell() >= file_bytes:
                    done.append((f"{folder}/{name}", out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder}/{name}", out.tell()))
            out.close()
        yield pd.DataFrame(done, columns=["path", "size"])

    return materialise(rows.mapInPandas(write, "path string, size long"), "warc-files")


def _parse(raw: bytes) -> dict | None:
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return fields | {"block": rest[: int(length)]}


def _inflate(f, at: int, chunk: int = 1 << 16) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and where it ends, or None if none with a WARC header does."""
    z, raw, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            f.seek(pos)
            data = f.read(chunk)
            if not data:
                return None
            raw += z.decompress(data)
            pos += len(data)
            if len(raw) >= 7 and not raw.startswith(b"WARC/1."):
                return None
            chunk = min(chunk * 4, 4 << 20)
    except zlib.error:
        return None
    return bytes(raw), pos - len(z.unused_data)


def _scan(f, start: int, end: int, chunk: int = 1 << 20) -> int | None:
    """First place in [start, end) where the magic bytes stand."""
    while start < end:
        f.seek(start)
        data = f.read(min(chunk, end - start) + len(MAGIC) - 1)
        if (k := data.find(MAGIC)) >= 0 and start + k < end:
            return start + k
        if len(data) < len(MAGIC):
            return None
        start += min(chunk, end - start)
    return None


def records_in_range(f, start: int, end: int) -> Iterator[tuple[int, dict]]:
    at = _scan(f, start, end)
    while at is not None and at < end:
        got = _inflate(f, at)
        fields = got and _parse(got[0])
        if fields:
            yield at, fields
            at = got[1]
            f.seek(at)
            if at < end and f.read(len(MAGIC)) == MAGIC:
                continue
        else:
            at += 1
        at = _scan(f, at, end)


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, payload: bool = True) -> DataFrame:
    """Response and revisit records of the archives in ``files`` (path, size), whatever the ranges' borders.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: a response's are taken from its bytes,
    a revisit's from its headers. ``payload`` is null for revisits, and for all if not asked for. An empty list of
    files gives an empty table.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        number = re.compile(re.escape(RECORD_ID) + r"(-?\d+)")
        for b in batches:
            for path, start, size in zip(b["path"], b["start"], b["size"]):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    for at, x in records_in_range(f, start, min(start + split_bytes, size)):
                        if x.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, body = x["block"].partition(b"\r\n\r\n")
                        own = x["warc-type"] == "response"
                        n = len(body) if own else int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
                        digest = payload_digest(body) if own else x["warc-payload-digest"].removeprefix("sha1:")
                        ids = [int(m[1]) if (m := number.search(x.get(k, ""))) else None for k in ("warc-record-id", "warc-refers-to")]
                        rows.append((ids[0], x.get("warc-target-uri"), x["warc-type"], ids[1], n, digest, body if own and payload else None, path, at))
                        held += n if payload else 200
                        if held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    wide = max(2, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut.repartition(wide, "path", "start").mapInPandas(read, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    b = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    return b.assign(page_id=b["page_id"].astype("Int64"), refers_to=b["refers_to"].astype("Int64"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_warc(with_revisits(pages), new_path(spark, "warc"))
    return read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP9 = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(sha1(coalesce(html, '')), (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
