"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each writing task makes archives of its own (a gzip member for each record) and returns
an index row for each record: file, offset, length, URL and digest. The index is written
as a table and names only archives of tasks that succeeded. A reader sorts the selected
index rows by file and offset, joins neighbouring records to byte ranges and reads each
range once. Files are opened through pyarrow's file systems, by the shared folder's URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir

#: Bytes of compressed records after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Records nearer than GAP bytes are read together, up to RANGE bytes at once.
GAP, RANGE = 64 << 10, 8 << 20
#: Groups of equal payloads up to this many (about 70 bytes each) are broadcast; more are joined by shuffle.
GROUPS_BROADCAST = 200_000
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3
_ID = "urn:page:"

INDEX = "id long, file string, offset long, length long, url string, digest string, type string"
READ = "id long, url string, type string, refers_to long, payload_bytes long, digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of a record; the payload of a revisit is None."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    payload = None if headers["warc-type"] == "revisit" else block[block.index(b"\r\n\r\n") + 4 :]
    own = re.fullmatch(rf"<{_ID}(.*)>", headers["warc-record-id"])[1]
    to = re.fullmatch(rf"<{_ID}(.*)>", headers["warc-refers-to"])[1] if "warc-refers-to" in headers else None
    return {"id": None if own == "none" else int(own), "url": headers["warc-target-uri"], "type": headers["warc-type"], "refers_to": int(to) if to else None, "digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload": payload}


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(key, refers_to): for each payload of several pages the largest page id, which is the response.

    Payloads are told apart by SHA-1 and length. Counted in each task before the shuffle,
    so a payload that a third of the pages have is a row a task.
    """
    found = pages.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("refers_to"), F.max("size").alias("size"))
    return found.where((F.col("n") > 1) & (F.col("size") >= min_bytes) & F.col("refers_to").isNotNull()).select("key", "refers_to")


def write(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages under out_dir and return the index, read back from its table.

    Null payloads count as empty, null URLs become urn:none, other characters than those of
    URLs are percent-encoded; null ids take part but a group of equal payloads without any
    id has no revisits. Where rows share an id and a payload, one of each id is the response
    only if the id occurs once in its group: repeated rows of the response's id are responses
    too. An empty table gives an empty index.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    size = F.length(payload)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.concat(F.unhex(F.sha1(payload)), size.cast("string").cast("binary")).alias("key"), size.cast("long").alias("size"))
    groups = cut(roles(rows.select("key", "id", "size"), min_bytes))
    few = groups.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST
    marked = rows.join(F.broadcast(groups) if few else groups, "key", "left").select("id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(out_dir) if "://" in out_dir or out_dir.startswith("file:") else (fs.LocalFileSystem(), out_dir)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base32_sha1(page["payload"])
                    revisit = page["refers_to"] is not None and page["refers_to"] != page["id"]
                    data = _member(record(page["id"], page["url"], page["payload"], digest, page["refers_to"], revisit))
                    out.write(data)
                    index.append((page["id"], name, at, len(data), page["url"], digest, "revisit" if revisit else "response"))
                    at += len(data)
                columns = list(zip(*index, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "file", "offset", "length", "url", "digest", "type"])
        finally:
            if out is not None:
                out.close()

    marked.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{out_dir}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{out_dir}/index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[str, int, int, list[int]]]:
    """Byte ranges (file, start, end, positions in rows) of rows (file, offset, length) sorted by file and offset."""
    out: list[tuple[str, int, int, list[int]]] = []
    for k, (file, offset, length) in enumerate(rows):
        if out and out[-1][0] == file and offset - out[-1][2] <= gap and offset + length - out[-1][1] <= most:
            _, start, end, inside = out[-1]
            out[-1] = (file, start, max(end, offset + length), inside)
            inside.append(k)
        else:
            out.append((file, offset, offset + length, [k]))
    return out


def read(selected: DataFrame, out_dir: str, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows: id, url, type, refers_to, payload_bytes, digest (as recomputed), payload.

    Size and digest are those of the payload read; a revisit has none, so its size is null
    and its digest is the recorded one. payloads=False leaves the payload column null.
    A response whose bytes don't have the recorded digest raises.
    """
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(out_dir) if "://" in out_dir or out_dir.startswith("file:") else (fs.LocalFileSystem(), out_dir)
        name, source = "", None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for file, start, end, inside in ranges(rows):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(f"{base}/{file}")
                data = source.read_at(end - start, start)
                found = []
                for k in inside:
                    _, offset, length = rows[k]
                    r = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    body = r["payload"]
                    if body is not None and base32_sha1(body) != r["digest"]:
                        raise ValueError(f"digest of record {r['id']} in {file}")
                    found.append((r["id"], r["url"], r["type"], r["refers_to"], None if body is None else len(body), r["digest"], body if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["id", "url", "type", "refers_to", "payload_bytes", "digest", "payload"])

    parts = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = selected.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, payload_bytes, digest, type, refers_to) of every page, from archives written to the shared folder.

    A revisit takes its size from the response it refers to. Many revisits may refer to one
    response; only ids and sizes are joined.
    """
    where = fresh_dir(pages.sparkSession, "warc")
    found = read(write(pages, where, id_col, url_col, payload_col), where, payloads=False).drop("payload", "url")
    found = cut(found)
    sizes = found.where("type = 'response'").groupBy("id", "digest").agg(F.max("payload_bytes").alias("size")).select(F.col("id").alias("to"), F.col("digest").alias("of"), "size")
    again = found.where("type = 'revisit'")
    solved = again.join(sizes, (again["refers_to"] == sizes["to"]) & (again["digest"] == sizes["of"]), "left").select("id", F.col("size").alias("payload_bytes"), "digest", "type", "refers_to")
    return found.where("type = 'response'").select("id", "payload_bytes", "digest", "type", "refers_to").unionByName(solved)
