from __future__ import annotations

import gzip
import hashlib
import io
import random
import zlib

import pytest

from pagemill.llm import warc
from pagemill.llm.store import file_system, put_file, shared_dir

KIND = "page_id long, url string, html string"


def table(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], KIND)


def got(df):
    from pyspark.sql import functions as F
    rows = df.select(warc.page_of(F.col("name")).alias("p"), "payload_bytes", "payload_digest", "kind", warc.page_of(F.col("refers")).alias("r"), "status")
    return sorted(map(tuple, rows.collect()), key=repr)


def brute(rows):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None, "ok"))
    return sorted(out, key=repr)


def pages():
    rnd = random.Random(6)
    big = ["".join(rnd.choices("abé\r\n<>0", k=n)) for n in (99, 100, 4096, 5000, 16_000, 40_000, 200_000)]
    rows = [(i, h) for i, h in enumerate(big * 2)] + [(50, None), (51, ""), (52, "WARC/1.1\r\n\r\n" * 30), (None, big[3]), (3, big[3]), (None, "only " * 40)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment,file", [(16 << 10, 32 << 20), (300, 5000), (97, 1)])
def test_round_trip(spark, segment, file):
    folder = shared_dir(spark, "t")
    files = warc.write_archives(table(spark, pages()).repartition(3), folder, segment_bytes=segment, file_bytes=file)
    assert got(warc.read_archives(files, folder)) == brute(pages())


def test_empty_table(spark):
    folder = shared_dir(spark, "t")
    assert got(warc.read_archives(warc.write_archives(table(spark, []), folder), folder)) == []


@pytest.mark.parametrize("payload", [b"", b"x", b"0\r\n\r\n" * 9, bytes(range(256)) * 50])
@pytest.mark.parametrize("size", [1, 7, 4096])
def test_framing(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(warc.chunked(payload, size)[:-5]) is None


def test_framing_details():
    assert warc.unchunked(b"3;name=value\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n") is None and warc.unchunked(b"zz\r\n") is None
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nContent-Type: x\r\n\r\nplain") == b"plain"


def test_broken_records_are_told(spark):
    folder = shared_dir(spark, "t")
    body = b"some payload " * 100
    digest = hashlib.sha256(body).hexdigest()
    whole = {n: warc.records_of(n, None, body, digest, None, 200) for n in range(1, 6)}
    wrong = warc.records_of(9, None, body, "0" * 64, None)
    lost = warc.records_of(8, None, b"", digest, 77)
    twice = whole[5] + whole[5][1:2]
    records = [*whole[1][::-1], *whole[2][:3], *whole[2][4:], *whole[3][:-1], *whole[4][1:], *twice, *wrong, *lost]
    put_file(folder, "a.warc.gz", [gzip.compress(r) for r in records])
    put_file(folder, "b.warc", [warc.records_of(6, "u", body, digest, None)[0], b"WARC/1.1\r\nContent-Length: 50\r\n\r\ncut off"])
    found = {r[0]: (r[1], r[5]) for r in got(warc.read_archives(spark.createDataFrame([("a.warc.gz",), ("b.warc",)], "file string"), folder))}
    assert found == {1: (len(body), "ok"), 2: (None, "segments missing"), 3: (None, "segments missing"), 4: (None, "segments missing"),
                     5: (len(body), "ok"), 6: (len(body), "ok"), 8: (None, "response missing"), 9: (len(body), "digest differs"),
                     None: (None, "cut off")}


def test_malformed_headers_and_members(spark):
    folder = shared_dir(spark, "t")
    body = b"some payload " * 100
    digest = hashlib.sha256(body).hexdigest()
    good = {n: warc.records_of(n, None, body, digest, None)[0] for n in range(1, 8)}
    size = b"Content-Length: %d" % len(warc._OK + warc.chunked(body))
    assert all(size in r for r in good.values())
    long = warc.records_of(8, None, body, digest, None, 600)
    files = {"a.warc": [good[1].replace(size, b"Content-Length: many"), good[2], long[0],
                        *(r.replace(b"WARC-Segment-Number: 2", b"WARC-Segment-Number: two") for r in long[1:])],
             "b.warc.gz": [gzip.compress(good[3]), gzip.compress(good[4])[:-40]],
             "c.warc.gz": [gzip.compress(good[5]), b"no gzip member"], "d.warc.gz": [b""], "e.warc": [b"WARC/1.1\r\nWARC-Type: resp"],
             "f.warc": [good[6].replace(size, b"Content-Length: 999999999999999999")], "g.warc": [good[7].replace(size, b"X: -1")]}
    for name, parts in files.items():
        put_file(folder, name, parts)
    rows = got(warc.read_archives(spark.createDataFrame([(n,) for n in files], "file string"), folder))
    fine = (len(body), digest, "response", None, "ok")
    assert [r for r in rows if r[5] == "ok"] == [(n, *fine) for n in (2, 3, 5)]
    assert sorted(((r[0], r[5]) for r in rows if r[5] != "ok"), key=repr) == sorted(
        [(1, "length unreadable"), (7, "length unreadable"), (6, "cut off"), (8, "number unreadable"), (8, "segments missing"),
         (None, "cut off"), (None, "cut off"), (4, "cut off")], key=repr)


def test_transfer_codings():
    body = b"text " * 50
    block = lambda codings, data: b"HTTP/1.1 200 OK\r\n" + codings + b"\r\n\r\n" + data
    packed = gzip.compress(body)
    assert warc.payload_of(block(b"transfer-encoding:chunked", warc.chunked(body))) == body
    assert warc.payload_of(block(b"Transfer-Encoding:  gzip ,\tChunked", warc.chunked(packed, 7))) == body
    assert warc.payload_of(block(b"Transfer-Encoding: deflate\r\nTransfer-Encoding: chunked", warc.chunked(zlib.compress(body)))) == body
    assert warc.payload_of(block(b"Transfer-Encoding: identity", body)) == body
    assert warc.payload_of(block(b"Transfer-Encoding: gzip", packed[:-9])) is None
    assert warc.payload_of(block(b"Transfer-Encoding: gzip, chunked", warc.chunked(body))) is None
    assert warc.payload_of(block(b"Transfer-Encoding: other", body)) is None
    assert warc.payload_of(block(b"X-Transfer-Encoding: chunked", body)) == body
    assert all(warc.unchunked(n + b"\r\na\r\n0\r\n\r\n") is None for n in (b"0x1", b"+1", b"-1", b"1_0", b"", b"\xc2\xb2"))


def test_parse_reads_fields():
    raw = warc.records_of(1, "http://x/", b"hi", hashlib.sha256(b"hi").hexdigest(), None)[0]
    (fields, block), = warc.parse(io.BufferedReader(io.BytesIO(raw)))
    assert fields["warc-target-uri"] == "http://x/" and warc.payload_of(block) == b"hi"
    assert file_system("file:///tmp/x")[1] == "/tmp/x"
