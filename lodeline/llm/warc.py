"""WARC archives: a writer with payload-digest revisits, and a sequential reader.

The writer puts one gzip member per record into files of bounded size. The reader walks a file in order with
incremental zlib decompression: a member's header block is parsed, Content-Length frames the block, the payload is
digested while it streams, and the digests in the headers are verified; no record need fit in one buffer of compressed
bytes, and no file is read whole.

Defined results: null html is an empty payload; a page_id repeated with the same html is written each time, as response
if it is the group's largest; a null page_id loses to any other and is written as `null`, as a revisit of the group's
largest where there is one. No rows: no archive, no rows
read. Truncated members, bad framing and wrong digests raise `BadRecord`.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import Scratch, group_totals, salt, shuffle_width, table, text_batches
from lodeline.llm.files import open_read, open_write

PAGE = "urn:lodeline:page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    pass


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes) -> bytes:
    """A response record, uncompressed."""
    return _framed(page_id, url, base32_sha1(payload), len(payload), payload, [])


def revisit(page_id, url: str | None, digest: str, size: int, refers_to) -> bytes:
    """A revisit record: the HTTP headers, with the full payload's length, and no payload."""
    return _framed(page_id, url, digest, size, b"", [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE}{refers_to}>"])


def _framed(page_id, url, digest: str, size: int, body: bytes, more: list[str]) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if more else 'response'}",
        f"WARC-Record-ID: <{PAGE}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "urn:lodeline:no-url").split()),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        *more,
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Member:
    """Decompressed bytes of one gzip member, read on demand from a stream shared with the next member."""

    def __init__(self, stream, held: bytes, step: int):
        self.stream, self.step, self.raw, self.out = stream, step, held, bytearray()
        self.z = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(self.step)
            if not self.raw:
                raise BadRecord("the file ends inside a gzip member")
        self.out += self.z.decompress(self.raw, self.step)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        at = 0
        while (k := self.out.find(mark, at)) < 0:
            at = max(0, len(self.out) - len(mark))
            if len(self.out) > most or not self.more():
                raise BadRecord("no end of a header block")
        got = bytes(self.out[:k])
        del self.out[: k + len(mark)]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise BadRecord("a block is shorter than its Content-Length")
            got = bytes(self.out[:n])
            del self.out[:n]
            n -= len(got)
            if got:
                yield got

    def rest(self) -> bytes:
        while self.more():
            if len(self.out) > 4:
                break
        return bytes(self.out)


def _fields(block: bytes, first: str) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise BadRecord(f"a record begins with {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _length(head: dict[str, str]) -> int:
    if not head.get("content-length", "").isdigit():
        raise BadRecord("no Content-Length")
    return int(head["content-length"])


def read_records(stream, step: int = 1 << 16, payloads: bool = False) -> Iterator[dict]:
    """Records of a WARC file in order: header fields, HTTP fields, payload length, verified digests.

    The payload is digested piece by piece; it is only kept with `payloads`.
    """
    held = b""
    while held or (held := stream.read(step)):
        m = _Member(stream, held, step)
        head = _fields(m.until(b"\r\n\r\n"), "WARC/")
        size = _length(head)
        block, body, kept, http = hashlib.sha1(), hashlib.sha1(), [], b""
        seen_http, body_bytes = "application/http" not in head.get("content-type", ""), 0
        for piece in m.take(size):
            block.update(piece)
            if not seen_http:
                http += piece
                k = http.find(b"\r\n\r\n")
                if k < 0:
                    continue
                seen_http, piece, http = True, http[k + 4 :], http[:k]
            body.update(piece)
            body_bytes += len(piece)
            if payloads:
                kept.append(piece)
        if m.rest() != b"\r\n\r\n":
            raise BadRecord("a record does not end with two line breaks")
        fields = _fields(http, "HTTP/") if http else {}
        told = lambda d: "sha1:" + base64.b32encode(d.digest()).decode()
        if "warc-block-digest" in head and head["warc-block-digest"] != told(block):
            raise BadRecord("the block's digest differs")
        if head.get("warc-type") == "response":
            if head.get("warc-payload-digest", told(body)) != told(body):
                raise BadRecord("the payload's digest differs")
            if "content-length" in fields and _length(fields) != body_bytes:
                raise BadRecord("the payload's length differs")
        yield {"head": head, "http": fields, "body_bytes": body_bytes, "payload": b"".join(kept) if payloads else None}
        held = m.raw


def _page(uri: str | None):
    tail = (uri or "").strip("<>").removeprefix(PAGE)
    return int(tail) if tail.lstrip("-").isdigit() else None


def write_archives(pages: DataFrame, folder: str, *, least_revisit: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Plan of a write: rows (path, records, bytes), a row per archive. Keep the rows to run it.

    Pages with equal payloads of at least `least_revisit` bytes share one response, that of the largest page_id.
    A lost task writes new files when it runs again; only files in the kept rows count.
    """
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Members are made before the shuffle, which then moves compressed bytes.
        for pdf in batches:
            out = []
            for pid, url, html, sha, at in zip(pdf["page"], pdf["url"], pdf["html"], pdf["sha"], pdf["_salt"]):
                payload = html.encode("utf-8", "surrogatepass")
                pid, url = _text(pid), _text(url)
                out.append((pid, url, sha, at, len(payload), gzip_member(record(pid, url, payload))))
            yield pd.DataFrame(out, columns=["page", "url", "sha", "_salt", "size", "member"])

    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    owners = group_totals(rows.select("page_id", "sha"), "sha", "page_id", [(F.max("page_id"), F.max, "owner")])
    # Ids as text: pandas would round large ids to floats next to nulls.
    text = rows.select(F.col("page_id").cast("string").alias("page"), "url", "html", "sha", salt("page_id").alias("_salt"))
    members = text.mapInPandas(packed, "page string, url string, sha binary, _salt long, size long, member binary")
    planned = members.join(owners, ["sha", "_salt"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = None
        n = size = 0
        done = []
        for pdf in batches:
            for pid, url, sha, n_bytes, member, owner in zip(pdf["page"], pdf["url"], pdf["sha"], pdf["size"], pdf["member"], pdf["owner"]):
                pid, url, owner = _text(pid), _text(url), _text(owner)
                again = n_bytes >= least_revisit and pid != owner
                data = gzip_member(revisit(pid, url, base64.b32encode(sha).decode(), n_bytes, owner)) if again else member
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = open_write(path), 0, 0
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    text_batches(pages.sparkSession)
    owner = F.col("owner").cast("string").alias("owner")
    return planned.select("page", "url", "sha", "size", "member", owner).mapInPandas(write, "path string, records long, bytes long")


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives at `path`, read in order, digests verified."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                with open_read(path) as stream:
                    for r in read_records(stream):
                        head = r["head"]
                        size = int(r["http"].get("content-length", r["body_bytes"]))
                        rows.append((_page(head.get("warc-record-id")), size, head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("warc-type"), _page(head.get("warc-refers-to")), head.get("warc-target-uri")))
                        if len(rows) >= 4096:
                            yield _typed(rows, names)
                            rows = []
                yield _typed(rows, names)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return archives.select("path").mapInPandas(read, kind)


def _typed(rows, names) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = scratch.keep(write_archives(table(spark, sf_dir, "pages"), scratch.path("archives")), "manifest")
    return read_archives(manifest.repartition(shuffle_width(spark))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS x, max(page_id) OVER (PARTITION BY sha1(html)) AS owner FROM p),
d AS (SELECT *, [('0x' || substr(x, 1 + 5 * i, 5))::BIGINT for i in range(8)] AS v FROM h)
SELECT page_id, n AS payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((w >> s) & 31))::INT, 1) for s in [15, 10, 5, 0]], '') for w in v], '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d
"""
