"""Shared folders, written tables and text blocks used by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one step inside a task handles at a time.
BLOCK_BYTES = 4 << 20
#: Reader options for large row groups: a vectored read takes a second buffer, outside the heap and kept by its thread, for all of a group.
PLAIN_READ = {"parquet.hadoop.vectored.io.enabled": "false"}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the one that all executors and the driver reach.

    Without that setting it is below the warehouse, the other shared place.

    The folder holds what a lazy result still reads, so it is left to the
    owner of the checkpoint folder to expire it, as with checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/pagemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, group_rows: int | None = None) -> DataFrame:
    """The rows written as Parquet and read again: they are computed once and outlive lost executors.

    Rows of megabytes need ``group_rows``, the most rows of a row group: a task holds
    a group whole to write or read it, and a writer first looks at its size after 100
    rows. They go without statistics, which hold a group's extreme values until the file ends.
    """
    out, back = df.write.option("compression", "zstd"), df.sparkSession.read.schema(df.schema)
    if group_rows is not None:
        out = out.option("parquet.block.row.count.limit", group_rows).option("parquet.column.statistics.enabled", "false")
        back = back.options(**PLAIN_READ)
    out.parquet(path)
    return back.parquet(path)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or a plain absolute path, as seen from a task."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, parts) -> None:
    """Write a file under a name of its own, then move it into place: a repeated task leaves the same whole file."""
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    place = f"{base}/_part-{uuid.uuid4().hex}"
    with fs.open_output_stream(place, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(place, f"{base}/{name}")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Rows with equal ids and equal texts share a key, others don't; nulls count as values."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                       F.coalesce(F.hex(F.xxhash64(F.col(text_col))), F.lit("null")),
                       F.coalesce(F.length(text_col).cast("string"), F.lit("null")))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets between them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def in_blocks(batches: Iterator[pa.RecordBatch], text_col: str,
              block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``block_bytes`` of text; a longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
            held.append(batch.slice(begin, stop - begin))
            size += int(ends[stop - 1] - before)
            begin = stop
            if size >= block_bytes or begin < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], …, starts[0] + counts[0] - 1, starts[1], …"""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)
