import base64
import gzip
import hashlib
import io
import zlib

import pytest

from foldwise.llm import warc as wa
from foldwise.llm.common import open_fs

SCHEMA = "page_id long, url string, html string"


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def slow(rows, least=0):
    out = []
    for i, u, h in rows:
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        size = len((h or "").encode())
        of = max(same) if same and size >= least and sum((x or "") == (h or "") for _, _, x in rows) > 1 else None
        out.append((i, u, size, b32(h), "revisit" if of is not None and of != i else "response", of if of is not None and of != i else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/1", "<p>x</p>"), (5, "http://a/5?q=é b", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "u\r\nX: y", None), (6, "http://a/6", ""),
        (7, "http://a/7", "é" * 200_000), (None, "http://n", "<p>x</p>"), (8, "%41", "WARC/1.1\r\n\r\n"), (9, "http://r", "same"), (9, "http://r", "same"),
        (2, "http://r", "same"), (None, "http://z", "only nulls"), (None, "http://z", "only nulls")]


@pytest.mark.parametrize("least,groups", [(0, 100_000), (5, 0)])
def test_round_trip(spark, least, groups):
    pages = spark.createDataFrame([(*r, "of", "payload") for r in ROWS], SCHEMA + ", of string, payload string")
    files = wa.write_archives(pages, revisit_bytes=least, file_bytes=200, broadcast_groups=groups)
    assert files.count() > 3
    got = sorted(map(tuple, wa.read_archives(files).collect()), key=str)
    assert got == slow(ROWS, least)


def test_empty_table(spark):
    files = wa.write_archives(spark.createDataFrame([], SCHEMA))
    assert wa.read_archives(files).count() == 0


def test_archives_are_members_of_one_record(spark):
    files = wa.write_archives(spark.createDataFrame(ROWS[:3], SCHEMA).coalesce(1))
    store, name = open_fs(files.first().path)
    data = store.open_input_stream(name, compression=None).read()
    members = []
    while data:
        z = zlib.decompressobj(31)
        members.append(z.decompress(data))
        data = z.unused_data
    assert [m[:8] for m in members] == [b"WARC/1.1"] * 4
    assert b"".join(members) == gzip.decompress(store.open_input_stream(name, compression=None).read())


def read(data, block=7):
    return [(h, b"".join(b)) for h, b in wa.Reader(io.BytesIO(data), block)]


def test_reader_frames_by_length_and_checks_digests():
    block = b"a\r\n\r\nWARC/1.1\r\n" * 50
    one = wa.record("resource", [("X-A", "b: c")], block, "2000-01-01T00:00:00Z")
    for size in (1, 7, 1 << 16):
        got = read(one * 3, size)
        assert [b for _, b in got] == [block] * 3 and got[0][0]["x-a"] == "b: c"
    assert read(b"") == []
    for bad in (one[:-9], one[:40], one + one[:30]):
        with pytest.raises((ValueError, zlib.error)):
            read(bad)
    plain = gzip.decompress(one)
    for wrong in (plain.replace(b"a\r\n", b"z\r\n", 1), plain + b"x", plain[:-4], plain.replace(b"Content-Length: 750", b"Content-Length: 749")):
        with pytest.raises(ValueError):
            read(gzip.compress(wrong))


def test_payload_digest_is_checked():
    data = wa.page_record("1", "u", b"payload", None, False, "2000-01-01T00:00:00Z")
    plain = gzip.decompress(data)
    h, b = next(iter(wa.Reader(io.BytesIO(data))))
    assert wa.payload_of(h, b) == (7, b32("payload"))
    wrong = plain.replace(b"payload", b"pAyload")
    block = wrong[wrong.index(b"\r\n\r\n") + 4:-4]
    wrong = wrong.replace(wa.base32_sha1(plain[plain.index(b"\r\n\r\n") + 4:-4]).encode(), wa.base32_sha1(block).encode())
    h, b = next(iter(wa.Reader(io.BytesIO(gzip.compress(wrong)))))
    with pytest.raises(ValueError, match="payload digest"):
        wa.payload_of(h, b)
