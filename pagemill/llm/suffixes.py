"""Removal of long repeated strings by suffix arrays over shards.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one. Matches
don't cross documents and are judged on the input.

1. Documents are stored in blocks, bucketed by groups of blocks that one task wrote, and stay where they are.
2. Every window of ``LENGTH`` bytes has an anchor, its least hash of ``ANCHOR``
   bytes. Runs of windows with one anchor become rows (anchor, hash of the
   run's bytes, place), first per block, and meet by anchor. Equal windows have
   equal anchors, so an anchor of one run has no repetition. Of runs with equal
   bytes the first stays, and all windows of the others repeat it.
3. Different runs with one anchor, and runs with their anchor twice, are cut
   out of the blocks and sent to shards by anchor. Each shard is sorted by
   induced sorting (``sais``), its permuted common prefixes group equal
   windows, and all but the first of a group repeat it.
4. An anchor with more bytes than a shard holds is split over several; their
   first windows meet once more by a 128-bit hash, counted before the shuffle.
5. What repeats goes back to the blocks as ranges, one row per group of blocks.

Runs count as equal when anchor, run hash (64 bits each) and length agree.
Null ids come after all others; rows that repeat an id stand in the order in
which they are read. A null text has no bytes. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.sais import common_prefixes, suffix_array
from pagemill.llm.store import in_blocks, shared_dir, spans_of, text_bytes, written

LENGTH = 100
ANCHOR = 20
BLOCK_BYTES = 2 << 20
#: Text bytes whose runs one task gathers, and bytes of different runs in one shard.
GATHER_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
#: Text that frequent anchors are looked for in; it decides how rows are spread, not what is found.
SAMPLE_BYTES = 24 << 20
_LAST = np.iinfo(np.int64).max
_U = np.uint64


# -- blocks ---------------------------------------------------------------------------------------

_BLOCK = "home long, block long, ids array<long>, sizes array<int>, data binary"
#: Blocks of one group have all but the last bits of their numbers in common; a task writes a file for each of its groups.
_HOME_BITS = 4


def stored_blocks(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in blocks, each in order of its ids; a bucketed table, so that joins by group move no text."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(in_blocks(batches, "text", block_bytes)):
            batch = batch.take(pc.sort_indices(batch.column("id"), null_placement="at_end"))
            data, offsets = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(base + number) >> _HOME_BITS]), pa.array([base + number]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")),
                 pa.array([np.diff(offsets).astype(np.int32)], pa.list_(pa.int32())), pa.array([data.tobytes()], pa.binary())],
                names=["home", "block", "ids", "sizes", "data"])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    name = f"pagemill_blocks_{uuid.uuid4().hex}"
    (rows.mapInArrow(store, _BLOCK).write.format("parquet").option("compression", "zstd").option("parquet.block.size", 8 << 20)
     .option("path", f"{folder}/blocks").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "home").saveAsTable(name))
    return spark.table(name)


def _with_rows(blocks: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """Blocks with an array of their rows (block, and what the array holds): only the rows are shuffled, by group of blocks."""
    values = [c for c in rows.columns if c != "block"]
    homed = rows.withColumn("h", F.shiftright("block", _HOME_BITS)).repartition("h")
    lists = homed.groupBy("h", "block").agg(F.collect_list(F.struct(*values)).alias("rows"))
    groups = lists.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("block", "rows"))).alias("of"))
    return blocks.join(groups.hint("shuffle_hash"), F.col("home") == F.col("h"), how).withColumn(name, F.col("of")[F.col("block")])


# -- runs -----------------------------------------------------------------------------------------

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, _U)
            x[0] = 1
            both.append(np.cumprod(x, dtype=_U))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place."""
    n = len(data) - ANCHOR + 1
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    x = words[:n] * _U(0x9FB21C651E98DF25)
    x ^= x >> _U(32)
    x += words[8:n + 8] * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x += words[ANCHOR - 8:n + ANCHOR - 8] * _U(0xA0761D6478BD642F)
    return _mixed(x)


def runs_of(data: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: anchor, print (hash of the bytes), start, n (windows), twice, doc (number)."""
    ends = np.cumsum(sizes, dtype=np.int64)
    windows = len(data) - LENGTH + 1
    none = {k: np.zeros(0, t) for k, t in (("anchor", _U), ("print", _U), ("start", np.int64), ("n", np.int64), ("twice", bool), ("doc", np.int64))}
    if windows <= 0:
        return none
    valid = (np.repeat(ends, sizes) - np.arange(len(data)) >= LENGTH)[:windows]
    if not valid.any():
        return none
    grams = gram_hashes(data)
    least = grams
    width, step = LENGTH - ANCHOR + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:windows], least[width - step:width - step + windows])
    change = least[1:] != least[:-1]
    start = np.flatnonzero(valid & np.concatenate([[True], change | ~valid[:-1]]))
    stop = np.flatnonzero(valid & np.concatenate([change | ~valid[1:], [True]])) + 1
    n = stop - start
    power, inverse = _powers(len(grams))
    sums = np.zeros(len(grams) + 1, _U)
    np.cumsum(grams * power[:len(grams)], out=sums[1:])
    prints = _mixed((sums[start + n + LENGTH - ANCHOR] - sums[start]) * inverse[start])
    # the anchor comes again after its first place has left the window
    again = np.flatnonzero((grams[:windows - 1] == least[:-1]) & ~change & valid[:-1] & valid[1:])
    twice = np.zeros(len(start), bool)
    twice[np.searchsorted(start, again, side="right") - 1] = True
    return {"anchor": least[start], "print": prints, "start": start, "n": n, "twice": twice,
            "doc": np.searchsorted(ends, start, side="right")}


_RUN = "part int, repeat boolean, anchor long, print long, doc long, block long, start int, n int, twice boolean"


def _part_of(anchor: np.ndarray, prints: np.ndarray, parts: int, hot: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Parts by hash of the anchor; a frequent anchor has several, chosen by ``prints``."""
    part = (_mixed(anchor) % _U(parts)).astype(np.int64)  # least hashes are small, so mixed again
    if len(hot):
        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        is_hot = hot[at] == anchor
        part[is_hot] = (part[is_hot] + (_mixed(prints[is_hot]) % split[at[is_hot]]).astype(np.int64)) % parts
    return part.astype(np.int32)


def _cells(batch: pa.RecordBatch, row: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    ids = pc.fill_null(batch.column("ids")[row].values, _LAST).to_numpy(zero_copy_only=False)
    return (batch.column("block")[row].as_py(), ids, batch.column("sizes")[row].values.to_numpy(),
            np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8))


def _block_runs(blocks: DataFrame, parts: int, hot: np.ndarray, split: np.ndarray) -> DataFrame:
    """Runs of each block, the first of equal ones; the others as ranges that repeat."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, sizes, data = _cells(batch, row)
                r = runs_of(data, sizes)
                order = np.lexsort((r["start"], r["n"], r["print"], r["anchor"]))
                same = np.zeros(len(order), bool)
                for key in ("anchor", "print", "n"):
                    x = r[key][order]
                    same[1:] |= x[1:] != x[:-1]
                same[1:] = ~same[1:]
                repeat = np.zeros(len(order), bool)
                repeat[order] = same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_part_of(r["anchor"], r["print"], parts, hot, split)), pa.array(repeat),
                     pa.array(r["anchor"].view(np.int64)), pa.array(r["print"].view(np.int64)), pa.array(ids[r["doc"]]),
                     pa.array(np.full(len(order), block)), pa.array(r["start"].astype(np.int32)),
                     pa.array(r["n"].astype(np.int32)), pa.array(r["twice"])],
                    names=["part", "repeat", "anchor", "print", "doc", "block", "start", "n", "twice"])

    return blocks.select("block", "ids", "sizes", "data").mapInArrow(work, _RUN)


def _frequent(blocks: DataFrame, total: int, parts: int, sample_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that would fill half a part or more, and how many parts each gets; from a sample of blocks."""
    every = max(1, total // sample_bytes)
    none = np.zeros(0, _U)
    if parts == 1:
        return none, none
    sample = _block_runs(blocks.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0), 1, none, none).where("not repeat")
    counts = written(sample.groupBy("anchor").agg(F.count("*").alias("n")), shared_dir(blocks.sparkSession, "anchors"))
    runs = counts.agg(F.sum("n")).first()[0] or 0
    least = max(4, runs // (2 * parts))
    rows = sorted((r["anchor"] & 0xFFFFFFFFFFFFFFFF, min(parts, 1 + 2 * r["n"] * parts // runs)) for r in counts.where(F.col("n") >= least).collect())
    return np.array([r[0] for r in rows], _U), np.array([r[1] for r in rows], _U)


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


_FOUND = "block long, start int, n int, need boolean, anchor long, doc long"


def _met(runs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Runs that meet by anchor: what repeats an equal run, and the different runs that need sorting."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        fresh = np.flatnonzero(~col["repeat"])
        key = {c: col[c][fresh] for c in ("anchor", "print", "n", "doc", "block", "start", "twice")}
        order = np.lexsort((key["start"], key["block"], key["doc"], key["n"], key["print"], key["anchor"]))
        key = {c: x[order] for c, x in key.items()}
        new_anchor = np.ones(len(order), bool)
        new_anchor[1:] = key["anchor"][1:] != key["anchor"][:-1]
        new_run = new_anchor.copy()
        for c in ("print", "n"):
            new_run[1:] |= key[c][1:] != key[c][:-1]
        group = np.cumsum(new_anchor) - 1
        several = (np.bincount(group, new_run) > 1) | (np.bincount(group, key["twice"]) > 0)
        if len(hot) and len(order):
            anchors = key["anchor"][new_anchor].view(_U)
            several |= hot[np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)] == anchors
        need = new_run & several[group]
        out = need | ~new_run
        old = np.flatnonzero(col["repeat"])
        both = lambda c: np.concatenate([key[c][out], col[c][old]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(both("block")), pa.array(both("start")), pa.array(both("n")),
             pa.array(np.concatenate([need[out], np.zeros(len(old), bool)])), pa.array(both("anchor")), pa.array(both("doc"))],
            names=["block", "start", "n", "need", "anchor", "doc"])

    return runs.repartitionById(parts, F.col("part")).mapInArrow(work, _FOUND)


# -- shards ---------------------------------------------------------------------------------------

_CUT = "part int, split boolean, doc long, block long, start int, n int, data binary"


def _cut_out(blocks: DataFrame, found: DataFrame, parts: int, hot: np.ndarray, split: np.ndarray) -> DataFrame:
    """The bytes of the runs that need sorting, with the shard that they go to."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                data = np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)
                runs = batch.column("runs")[row].values
                start, n, anchor, doc = (runs.field(c).to_numpy() for c in ("start", "n", "anchor", "doc"))
                size = n.astype(np.int64) + LENGTH - 1
                anchor = anchor.view(_U)
                place = (_U(block) << _U(24)) + start.astype(_U)
                at = np.concatenate([[0], np.cumsum(size)])
                joined = np.concatenate([data[a:a + m] for a, m in zip(start.tolist(), size.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_part_of(anchor, place, parts, hot, split)), pa.array(np.isin(anchor, hot)), pa.array(doc),
                     pa.array(np.full(len(n), block)), pa.array(start), pa.array(n),
                     pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(joined)]).cast(pa.binary())],
                    names=["part", "split", "doc", "block", "start", "n", "data"])

    runs = found.where("need").select("block", "start", "n", "anchor", "doc")
    return (_with_rows(blocks.select("home", "block", "data"), runs, "runs", "inner").where("runs is not null")
            .select("block", "data", "runs").mapInArrow(work, _CUT))


def repeats(segments: list[tuple[int, int]], text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places of ``text`` start a window that also starts earlier.

    ``segments``: (begin, windows) of each run in ``text``, where signs run from 1 and runs are divided by 255.
    """
    start = np.zeros(len(text), bool)
    for begin, n in segments:
        start[begin:begin + n] = True
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    order = order[start[order]]  # equal windows stand together, and only windows can equal one
    if not len(order):
        return start
    heads = shared[order] < length
    heads[0] = True
    first = np.minimum.reduceat(order, np.flatnonzero(heads))
    repeated = np.zeros(len(text), bool)
    repeated[order] = order != first[np.cumsum(heads) - 1]
    return repeated


_SORTED = "block long, start int, n int, doc long, print binary"


def _sorted_shards(cut: DataFrame, parts: int) -> DataFrame:
    """Ranges of windows that repeat an earlier one of their shard; of split anchors also the first windows with a hash."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        # in order of place, so that a smaller place in the shard's text is an earlier one
        table = table.sort_by([("doc", "ascending"), ("block", "ascending"), ("start", "ascending")]).combine_chunks()
        data, offsets = _binary(table.column("data").combine_chunks())
        n = table.column("n").to_numpy().astype(np.int64)
        begins = offsets[:-1] + np.arange(len(n))
        text = np.full(len(data) + len(n), 255, np.uint8)
        inside = np.ones(len(text), bool)
        inside[offsets[1:] + np.arange(len(n))] = False
        text[inside] = data + 1
        repeated = repeats(list(zip(begins.tolist(), n.tolist())), text)
        a, b = spans_of(repeated)
        row = np.searchsorted(begins, a, side="right") - 1
        block, start, doc = (table.column(c).to_numpy() for c in ("block", "start", "doc"))
        names = ["block", "start", "n", "doc", "print"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[row]), pa.array((start[row] + a - begins[row]).astype(np.int32)), pa.array((b - a).astype(np.int32)),
             pa.array(doc[row]), pa.nulls(len(row), pa.binary())], names=names)
        for i in np.flatnonzero(table.column("split").to_numpy()).tolist():
            at = begins[i] + np.flatnonzero(~repeated[begins[i]:begins[i] + n[i]])
            if len(at):
                raw = text[begins[i]:begins[i] + n[i] + LENGTH - 1].tobytes()
                prints = [xxhash.xxh3_128_digest(raw[p:p + LENGTH]) for p in (at - begins[i]).tolist()]
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, block[i])), pa.array((start[i] + at - begins[i]).astype(np.int32)),
                     pa.array(np.ones(k, np.int32)), pa.array(np.full(k, doc[i])), pa.array(prints, pa.binary())], names=names)

    return cut.repartitionById(parts, F.col("part")).mapInArrow(work, _SORTED)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _across(firsts: DataFrame) -> DataFrame:
    """Windows of split anchors that are the first of their shard but not of all."""
    place = F.struct("doc", "block", "start")
    least = firsts.groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    both = firsts.join(least.select(F.col("print").alias("p"), "first"), F.col("print") == F.col("p"))
    return both.where(place != F.col("first")).select("block", "start", "n")


# -- result ---------------------------------------------------------------------------------------

def _finished(blocks: DataFrame, ranges: DataFrame, with_kept: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)
                sizes = batch.column("sizes")[row].values.to_numpy().astype(np.int64)
                edge = np.zeros(len(data) + 1, np.int32)
                if batch.column("ranges")[row].is_valid:
                    ranges = batch.column("ranges")[row].values
                    start, n = ranges.field("start").to_numpy(), ranges.field("n").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + LENGTH - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                ends = np.cumsum(sizes)
                spans, removed, digests, kept = [], [], [], []
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    here = gone[a:b]
                    begin, end = spans_of(here)
                    rest = data[a:b][~here].tobytes() if len(begin) else data[a:b].tobytes()
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(begin, end)])
                    removed.append(int(here.sum()))
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                columns = [batch.column("ids")[row].values, pa.array(sizes), pa.array(removed, pa.int64()),
                           pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                           pa.array(digests, pa.string())] + [pa.array(kept, pa.binary())] * with_kept
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"] + ["kept"] * with_kept)

    both = _with_rows(blocks, ranges, "ranges", "left")
    kind = ("id long, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string"
            + ", kept binary" * with_kept)
    return both.select("ids", "sizes", "data", "ranges").mapInArrow(work, kind)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False,
                    block_bytes: int = BLOCK_BYTES, gather_bytes: int = GATHER_BYTES, shard_bytes: int = SHARD_BYTES,
                    sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, spans (removed bytes, end exclusive), kept_sha256 and, if asked for, the kept bytes."""
    folder = shared_dir(docs.sparkSession, "suffixes")
    blocks = stored_blocks(docs, folder, id_col, text_col, block_bytes)
    total = blocks.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // gather_bytes))
    hot, split = _frequent(blocks, total, parts, sample_bytes)
    found = written(_met(_block_runs(blocks, parts, hot, split), parts, hot), f"{folder}/found")

    need = found.where("need").select("anchor", (F.col("n") + LENGTH - 1).cast("long").alias("bytes"))
    size = need.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    large = need.groupBy("anchor").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > shard_bytes // 2) if shards > 1 else need.limit(0)
    rows = sorted((r["anchor"] & 0xFFFFFFFFFFFFFFFF, min(shards, 1 + 2 * r["bytes"] // shard_bytes)) for r in large.collect())
    hot, split = np.array([r[0] for r in rows], _U), np.array([r[1] for r in rows], _U)
    cut = _cut_out(blocks, found, shards, hot, split)
    done = written(_sorted_shards(cut, shards), f"{folder}/sorted")

    ranges = found.where("not need").select("block", "start", "n").unionByName(
        done.where("print is null").select("block", "start", "n")).unionByName(_across(done.where("print is not null")))
    return _finished(blocks, ranges, with_kept)
