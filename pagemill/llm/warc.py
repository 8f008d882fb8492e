"""WARC archives with segmented records and chunked transfer framing.

``write_archives`` writes one record per page: a response with the payload in
chunked framing, or a revisit where an equal payload of ``REVISIT_BYTES`` or
more is the response of a page with a smaller id. A block longer than
``segment_bytes`` is cut: its first segment is the response record, the others
are continuation records in files of their own.

``read_archives`` streams the files, puts segments together by the identifier
of their origin, in order of their number, verifies that none is missing and
that the total length is as stated, takes the framing off, and verifies the
payload digest. What can't be verified is kept as a row with its ``status``:
"segments missing", "length differs", "digest differs", "broken framing" or
"response missing"; "cut off" for a record that its file or gzip member ends
within, which ends the file; "length unreadable" and "number unreadable" for a
record whose header doesn't say these as decimal digits, after which the next
record is looked for.

Record names are unique: behind "#" they tell the task and the number of the
record in it, and a reference names all before "#", as it is about the page.

A null payload is empty. Rows that repeat the smallest id of an equal payload
are all responses; a null id never is the smallest, and rows with null ids
only are all responses. Segments that are repeated byte for byte count once.
An empty table gives no files and no rows, a payload of any length is cut into
segments, and other columns of the table, whatever their names, aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import file_system, in_blocks, put_file, shared_dir, written

REVISIT_BYTES = 100
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: A file is closed once it has so many bytes.
FILE_BYTES = 32 << 20
_END = b"\r\n"
_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_NOT_MODIFIED = b"HTTP/1.1 304 Not Modified\r\n\r\n"


# -- framing --------------------------------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts += [b"%x" % len(piece), _END, piece, _END]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or the last chunk is missing."""
    parts, at = [], 0
    while True:
        end = body.find(_END, at)
        if end < 0:
            return None
        size = body[at:end].split(b";", 1)[0].strip(b" \t")
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n:at + n + 2] != _END:
            return None
        parts.append(body[at:at + n])
        at += n + 2


def _uncompressed(body: bytes, coding: str) -> bytes | None:
    try:
        return gzip.decompress(body) if coding.endswith("gzip") else zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        return None


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block, its transfer codings undone from the last to the first; None if it can't be decoded."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    codings: list[str] = []
    for line in head.split(_END)[1:]:
        name, _, value = line.decode("latin-1").partition(":")
        if name.strip().lower() == "transfer-encoding":
            codings += [c.split(";")[0].strip().lower() for c in value.split(",")]
    out: bytes | None = body
    for coding in reversed([c for c in codings if c not in ("", "identity")]):
        if out is None:
            return None
        if coding == "chunked":
            out = unchunked(out)
        elif coding in ("gzip", "x-gzip", "deflate"):
            out = _uncompressed(out, coding)
        else:
            return None
    return out


# -- writing --------------------------------------------------------------------------------------

def _record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + _END + _END


def _member(record: bytes) -> bytes:
    """A gzip member of its own for each record."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _name(page: object, digest: str) -> str:
    return f"urn:page:{'null' if page is None else page}:{digest}"


def records_of(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None,
               segment_bytes: int = SEGMENT_BYTES, place: str = "0") -> list[bytes]:
    """The record of a page; behind it its continuations. first: the page whose payload it repeats."""
    common = {"WARC_Target_URI": " ".join((url or "").split()) or None, "WARC_Payload_Digest": f"sha256:{digest}"}
    name = f"{_name(page, digest)}#{place}"
    if first is not None:
        return [_record("revisit", name, _NOT_MODIFIED, WARC_Refers_To=f"<{_name(first, digest)}>", **common,
                        WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = _OK + chunked(payload)
    pieces = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(pieces) == 1:
        return [_record("response", name, block, **common)]
    out = [_record("response", name, pieces[0], WARC_Segment_Number=1, **common)]
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        out.append(_record("continuation", f"{name}:{n}", piece, WARC_Segment_Origin_ID=f"<{name}>",
                           WARC_Segment_Number=n, WARC_Segment_Total_Length=total))
    return out


def with_digests(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url",
                 least: int = REVISIT_BYTES) -> DataFrame:
    """id, url, payload, digest and first (the page to refer to, null for responses) of every row."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    # only payloads that occur again are joined; stored, so that Spark knows their size and needn't shuffle payloads for a few
    again = (rows.where(F.octet_length("payload") >= least).groupBy("digest")
             .agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "least"))
    again = written(again, shared_dir(pages.sparkSession, "warc-again"))
    first = F.when(~F.col("least").eqNullSafe(F.col("id")), F.col("least"))
    return rows.join(again, F.col("digest") == F.col("d"), "left").select("id", "url", "payload", "digest", first.alias("first"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html",
                   url_col: str | None = "url", segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives below ``folder``; the rows name the files."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, done = TaskContext.get().partitionId(), [], 0
        held: dict[str, list[bytes]] = {"page": [], "more": []}
        size = dict.fromkeys(held, 0)

        def close(kind: str) -> None:
            if held[kind]:
                names.append(f"{kind}-{task:06d}-{len(names):04d}.warc.gz")
                put_file(folder, names[-1], held[kind])
                held[kind], size[kind] = [], 0

        for batch in in_blocks(batches, "payload"):
            for row in batch.to_pylist():
                records = records_of(row["id"], row["url"], row["payload"].encode(), row["digest"], row["first"], segment_bytes,
                                     f"{task}.{done}")
                done += 1
                for n, record in enumerate(records):
                    kind, packed = ("more" if n else "page"), _member(record)
                    held[kind].append(packed)
                    size[kind] += len(packed)
                    if size[kind] >= file_bytes:
                        close(kind)
        for kind in held:
            close(kind)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    rows = with_digests(pages, id_col, payload_col, url_col)
    return written(rows.mapInArrow(write, "file string"), f"{folder}/files")


# -- reading --------------------------------------------------------------------------------------

def _number(text: str | None, digits: int = 18) -> int | None:
    """A header value of decimal digits; None for anything else."""
    return int(text) if text is not None and re.fullmatch(rf"[0-9]{{1,{digits}}}", text) else None


def _read(stream: io.BufferedIOBase, size: int) -> bytes:
    """``size`` bytes, or what is left; a stated size beyond the file takes no memory of its own."""
    parts = []
    while size > 0 and (part := stream.read(min(size, 1 << 20))):
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def records_in(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Header fields (names in lower case) and block of each record; without a block, what is wrong with the record."""
    while True:
        fields: dict[str, str] = {}
        try:
            if not (line := stream.readline()):
                return
            if not line.startswith(b"WARC/"):
                continue
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            size = _number(fields.get("content-length"))
            block = _read(stream, size or 0)
        except (EOFError, gzip.BadGzipFile, zlib.error):  # other errors are the store's: the task is run again
            yield fields, None, "cut off"
            return
        if size is not None and len(block) < size or not line:
            yield fields, None, "cut off"
            return
        yield (fields, None, "length unreadable") if size is None else (fields, block, None)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each whole record."""
    return ((fields, block) for fields, block, _ in records_in(stream) if block is not None)


def _open(folder: str, name: str) -> io.BufferedIOBase:
    fs, base = file_system(folder)
    stream = fs.open_input_stream(f"{base}/{name}", compression=None)
    # no further buffer around the gzip file: where a member breaks off, that would lose the records before it
    return gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else io.BufferedReader(stream, 1 << 20)


_PARSED = ("name string, kind string, refers string, stated string, origin string, number int, total long, "
           "block binary, payload_bytes long, payload_digest string, status string")
_COLUMNS = ["name", "kind", "refers", "stated", "origin", "number", "total", "block", "payload_bytes", "payload_digest", "status"]


def _judged(block: bytes, stated: str | None) -> tuple[int | None, str | None, str]:
    payload = payload_of(block)
    if payload is None:
        return None, None, "broken framing"
    digest = hashlib.sha256(payload).hexdigest()
    return len(payload), digest, "ok" if stated in (None, digest) else "digest differs"


def _row(fields: dict[str, str], block: bytes | None, wrong: str | None) -> tuple:
    bare = lambda key: fields[key].strip("<>") if key in fields else None
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    number, total = _number(fields.get("warc-segment-number"), 9), _number(fields.get("warc-segment-total-length"))
    if (number is None and "warc-segment-number" in fields) or (total is None and "warc-segment-total-length" in fields):
        wrong = wrong or "number unreadable"
    origin = bare("warc-segment-origin-id") or (bare("warc-record-id") if number is not None else None)
    rest = (None, None, None, None)
    if wrong is not None:
        number, total, rest = None, None, (None, None, None, wrong)
    elif number is not None:
        rest = (block, None, None, None)
    elif kind == "response":
        rest = (None, *_judged(block, stated))
    return (bare("warc-record-id"), kind, bare("warc-refers-to"), stated, origin, number, total, *rest)


def reassembled(segments: DataFrame) -> DataFrame:
    """One row per origin: segments in order of their numbers, verified, framing taken off.

    ``segments``: origin, number, total, block, and kind, refers, stated of the first one. A record's segments together
    are one payload, so they fit a task as the payload itself does.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts")):
                parts = parts.as_py()
                first = next((p for p in parts if p["number"] == 1), {})
                block = b"".join(p["block"] for p in parts)
                totals = {p["total"] for p in parts} - {None}
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or not totals:
                    judged = (None, None, "segments missing")
                elif totals != {len(block)}:
                    judged = (None, None, "length differs")
                else:
                    judged = _judged(block, first.get("stated"))
                out.append((origin, first.get("kind"), first.get("refers"), *judged))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [()] * 6, [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string()])],
                names=["name", "kind", "refers", "payload_bytes", "payload_digest", "status"])

    part = F.struct("number", "block", "total", "kind", "refers", "stated")
    grouped = segments.groupBy("origin").agg(F.sort_array(F.collect_set(part)).alias("parts"))
    return grouped.mapInArrow(join, "name string, kind string, refers string, payload_bytes long, payload_digest string, status string")


def page_of(name: Column) -> Column:
    """The page id in a record name."""
    return F.regexp_extract(name, r"^urn:page:(-?\d+):", 1).try_cast("long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """name, kind, refers, payload_bytes, payload_digest, status of every record of the files.

    ``files``: a table of file names (file). A revisit has the payload of the
    record that it refers to.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

        def rows_out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_COLUMNS)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with _open(folder, name) as stream:
                    for record in records_in(stream):
                        rows.append(_row(*record))
                        size += len(rows[-1][7] or b"") + 400
                        if size > 4 << 20:
                            yield rows_out(rows)
                            rows, size = [], 0
                if rows:
                    yield rows_out(rows)

    names = files.select("file").repartition(min(max(1, files.count()), 10_000), "file")
    parsed = written(names.mapInArrow(read, _PARSED), f"{folder}/parsed")
    columns = ["name", "kind", "refers", "payload_bytes", "payload_digest", "status"]
    # a record that couldn't be read has its status from the start; of the others, responses only
    whole = parsed.where("number is null and (status is not null or kind = 'response')").select(columns)
    responses = whole.unionByName(reassembled(parsed.where("number is not null")).select(columns))
    responses = written(responses, f"{folder}/responses")
    revisits = parsed.where("kind = 'revisit' and status is null").select("name", "kind", "refers", "stated")
    about = lambda name: F.substring_index(name, "#", 1)
    there = responses.where("kind = 'response'").groupBy(about("name").alias("n")).agg(F.min(F.struct("payload_bytes", "payload_digest", "status")).alias("r"))
    found = revisits.join(there, about("refers") == F.col("n"), "left")
    status = F.when(F.col("n").isNull(), "response missing").when(
        (F.col("r.status") == "ok") & ~F.col("stated").eqNullSafe(F.col("r.payload_digest")), "digest differs").otherwise(F.col("r.status"))
    return responses.unionByName(found.select("name", "kind", "refers", "r.payload_bytes", "r.payload_digest", status.alias("status")))
