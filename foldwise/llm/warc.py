"""WARC archives: writer with revisit records, and sequential reader.

An archive is a sequence of records, each a gzip member of its own.  The reader feeds
compressed blocks to one ``zlib`` decompressor per member, takes as many bytes as
Content-Length says, and checks block and payload digests as the bytes pass, so memory
is bounded by a block whatever the size of a record.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import materialize, new_dir, open_fs
from foldwise.llm.tokens import utf8

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters that a header value holds as they are; others are percent-encoded.
PLAIN = "".join(map(chr, range(33, 127))).replace("%", "")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id!r} {digest}')}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes, date: str, level: int = 6) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Date: {date}", *[f"{k}: {v}" for k, v in headers if v is not None],
             f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """The response record of a page, or its revisit record, whose block has no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", [
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", None if url is None else quote(url, safe=PLAIN)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Page-ID", None if page_id is None else quote(page_id, safe=PLAIN)),
        ("X-Refers-To-Page-ID", quote(refers_to, safe=PLAIN) if revisit and refers_to is not None else None),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload, date)


class Reader:
    """Iterates over the records of an archive as (headers, block chunks).

    The chunks of a record must be taken before the next record is; what is left of them
    is read over.  Raises ValueError on a torn member, a record that does not fill its
    member, or a block digest that does not agree."""

    def __init__(self, source, block_bytes: int = 1 << 16):
        self.source, self.size = source, block_bytes
        self.raw, self.out, self.z = b"", b"", None

    def _more(self) -> bool:
        """Decompress some more of the member; false at its end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.raw or self.source.read(self.size)
            if not self.z.unconsumed_tail:
                self.raw = b""
            if not data:
                raise ValueError("archive ends inside a record")
            got = self.z.decompress(data, self.size)
            if self.z.eof:
                self.raw = self.z.unused_data
            if got:
                self.out += got
                return True
        return False

    def _exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise ValueError("record is shorter than its Content-Length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            yield part

    def _until(self, mark: bytes, most: int = 1 << 24) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if len(self.out) > most or not self._more():
                raise ValueError("record header has no end")
        head, self.out = self.out[:at], self.out[at + len(mark):]
        return head

    def _block(self, headers: dict[str, str]) -> Iterator[bytes]:
        sums = hashlib.sha1()
        for part in self._exactly(int(headers["content-length"])):
            sums.update(part)
            yield part
        want = headers.get("warc-block-digest")
        if want and want != f"sha1:{base64.b32encode(sums.digest()).decode()}":
            raise ValueError("block digest does not agree")

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.size)
            if not self.raw:
                return
            self.z, self.out = zlib.decompressobj(31), b""
            lines = self._until(b"\r\n\r\n").decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            block = self._block(headers)
            yield headers, block
            for _ in block:
                pass
            if b"".join(self._exactly(4)) != b"\r\n\r\n" or self.out or self._more():
                raise ValueError("a record does not fill its gzip member")


def payload_of(headers: dict[str, str], block: Iterator[bytes]) -> tuple[int, str]:
    """(bytes, digest) of a record's full payload.  That of a response is read and checked;
    a revisit's block has none, and its headers tell."""
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] != "response":
        return int(headers["x-payload-length"]), digest
    head, n, sums, inside = b"", 0, hashlib.sha1(), False
    for part in block:
        if not inside:
            head += part
            if (at := head.find(b"\r\n\r\n")) < 0:
                continue
            part, inside = head[at + 4:], True
        n += len(part)
        sums.update(part)
    if base64.b32encode(sums.digest()).decode() != digest or n != int(headers.get("x-payload-length", n)):
        raise ValueError("payload digest does not agree")
    return n, digest


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   revisit_bytes: int = 0, out_dir: str | None = None, date: str = "1970-01-01T00:00:00Z",
                   file_bytes: int = 256 << 20, broadcast_groups: int = 100_000) -> DataFrame:
    """Write a record per page; returns the manifest (path, n_records), stored.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes, that with the largest id is
    a response, and the others are revisit records that refer to it; rows repeated with
    that id are responses too, and so are all of a group whose ids are all null.  A null
    html is an empty payload; a null url or id is left out of the record.  Only groups
    of more than one page are joined to the pages: a broadcast if they are at most
    ``broadcast_groups`` (counted first).  An archive's name is new for each attempt,
    and only archives of attempts that ended are in the manifest."""
    out_dir = out_dir or new_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    key = F.concat_ws(":", F.sha1("html"), F.octet_length("html").cast("string")).alias("payload")
    same = materialize(rows.where(F.octet_length("html") >= revisit_bytes).select("id", key).groupBy("payload")
                       .agg(F.max("id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1 and of is not null").select("payload", "of"))
    if same.count() <= broadcast_groups:
        same = F.broadcast(same)
    rows = (rows.select("*", key).join(same, "payload", "left")
            .select(F.col("id").cast("string").alias("id"), "url", "html", F.col("of").cast("string").alias("of"),
                    (F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("of"))).alias("revisit")))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        store, folder = open_fs(out_dir)
        store.create_dir(folder, recursive=True)
        records = (r for b in itertools.chain([first], batches)
                   for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(),
                                b.column(4).to_pylist()))
        paths, counts = [], []
        row = next(records, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            written = n = 0
            with store.open_output_stream(f"{folder}/{name}", compression=None) as sink:
                info = b"format: WARC file version 1.1\r\n"
                sink.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                                               ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info, date))
                while row is not None and written < file_bytes:
                    data = page_record(row[0], row[1], row[2], row[3], row[4], date)
                    sink.write(data)
                    written, n = written + len(data), n + 1
                    row = next(records, None)
            paths.append(f"{out_dir}/{name}")
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64())], names=["path", "n_records"])

    return materialize(rows.mapInArrow(write, schema))


def read_archives(manifest: DataFrame, id_type: T.DataType | None = None, id_col: str = "page_id") -> DataFrame:
    """Read archives: (id, url, payload_bytes, payload_digest, record_type, refers_to), a row for
    each response and revisit record; other records are read over.  An archive that does
    not hold as many records as the manifest says is an error, as is any wrong digest."""
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"

    def read(batches):
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for uri, n_records in zip(b.column("path").to_pylist(), b.column("n_records").to_pylist()):
                store, name = open_fs(uri)
                rows, found = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for h, block in Reader(source):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        size, digest = payload_of(h, block)
                        text = [unquote(h[k]) if k in h else None for k in ("x-page-id", "warc-target-uri", "x-refers-to-page-id")]
                        rows.append((text[0], text[1], size, digest, h["warc-type"], text[2]))
                        found += 1
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                if found != n_records:
                    raise ValueError(f"{uri} holds {found} records, not {n_records}")
                if rows:
                    yield batch(rows)

    kind = id_type or T.LongType()
    return (manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)
            .select(F.col("id").cast(kind).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type",
                    F.col("refers_to").cast(kind).alias("refers_to")))
