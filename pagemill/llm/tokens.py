"""Token ids in raw binary shards, with keyed access through a minimal perfect hash.

Files below a folder, integers little-endian:

* ``shard-N.ids``: the ids of its documents one after another, uint16 or uint32, nothing else. Shards hold ascending
  ranges of document ids.
* ``index-P.mph``: for the keys of one index part, a header of nine uint64 (magic, keys, levels, then the words of up to
  six levels), the bit arrays of the levels, 64-bit ranks before every word, and for each slot a fingerprint (uint32),
  shard (uint32), offset in ids (uint64) and number of ids (uint32).

A key is hashed to a bit of the first level; a bit that only one key of the
part wants is that key's, the others go on to the next level, and the last
few are listed with their hashes. The rank of the bit is the slot, so the
hash is minimal and a look-up takes a few steps whatever the number of keys.
A fingerprint from other hash bits rejects nearly all foreign keys.

A key is (id, k): k numbers rows that repeat an id, in order of a hash of
their text; such rows may fill several shards. A null id is a value of its
own, before all others. A null text is empty and
has the end id only. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.store import file_system, in_blocks, put_file, written

#: Text bytes meant for one shard, keys meant for one index part.
SHARD_BYTES = 32 << 20
PART_KEYS = 1 << 17
END_ID = 1
#: Texts encoded at a time.
_AT_ONCE = 64
_MAGIC = 0x3148504D
_LEVELS = 6
_LEFT = np.uint64(_LEVELS)

# -- encoding -------------------------------------------------------------------------------------

#: A normaliser's step from white space to one blank, and a splitter whose words hold no white space and don't look past their ends.
_BLANKS = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
          "behavior": "Removed", "invert": True}


def without_blanks(spec: dict) -> dict:
    """A tokenizer file without the step ``_BLANKS``, where its ids can't depend on it; any other file as it is.

    That is so if only lower-casing, which goes letter by letter, stands
    between the step and ``_WORDS``, and added tokens are found before it.
    """
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [])
    idle = (_BLANKS in steps and all(s == {"type": "Lowercase"} for s in steps[steps.index(_BLANKS) + 1:])
            and splitter.get("pretokenizers", [splitter])[:1] == [_WORDS]
            and not any(t["normalized"] for t in spec["added_tokens"]))
    return spec | {"normalizer": normalizer | {"normalizers": [s for s in steps if s != _BLANKS]}} if idle else spec


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library, each text followed by the end id."""

    def __init__(self, path: str, dtype: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = without_blanks(json.load(file))
        self.tokenizer, self.dtype, self.end_id = Tokenizer.from_str(json.dumps(spec)), dtype, end_id
        most = max([end_id, *self.tokenizer.get_vocab(with_added_tokens=True).values()])
        if most > np.iinfo(dtype).max:
            raise ValueError(f"ids up to {most} don't fit {dtype}")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; equal texts of the column are encoded once."""
        coded = pc.fill_null(column.cast(pa.large_string()), "").dictionary_encode()
        texts = []
        for i in range(0, len(coded.dictionary), _AT_ONCE):  # an encoding takes far more memory than its ids
            part = coded.dictionary.slice(i, _AT_ONCE).to_pylist()
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)  # the same ids, without offsets
            texts += [np.array([*e.ids, self.end_id], self.dtype) for e in found]
        order = coded.indices.to_numpy(zero_copy_only=False).tolist()
        out = np.concatenate([np.zeros(0, self.dtype), *(texts[i] for i in order)])
        return out, np.fromiter((len(texts[i]) for i in order), np.int64, len(order))


_ENTRY = "shard int, id long, k int, offset long, n int"


def encode_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  dtype: str = "<u2", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; the rows tell where each document's ids are: shard, id, k, offset (in ids), n."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text").asc())
    ordered = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), Encoder(tokenizer, dtype)
        entries: list[pa.RecordBatch] = []
        last: list = [object(), -1]

        def parts() -> Iterator[bytes]:
            offset = 0
            for batch in in_blocks(batches, "text"):
                ids, n = encoder.encode(batch.column("text"))
                keys = batch.column("id").to_pylist()
                k = np.zeros(len(keys), np.int32)
                for i, key in enumerate(keys):
                    last[1] = last[1] + 1 if key == last[0] else 0
                    last[0] = key
                    k[i] = last[1]
                ends = np.cumsum(n)
                entries.append(pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, np.int32)), batch.column("id"), pa.array(k),
                     pa.array(offset + ends - n), pa.array(n.astype(np.int32))], names=["shard", "id", "k", "offset", "n"]))
                offset += int(ends[-1])
                yield ids.tobytes()

        put_file(folder, f"shard-{shard:06d}.ids", parts())
        yield from entries

    return _numbered(written(ordered.mapInArrow(write, _ENTRY), f"{folder}/entries"))


def _numbered(entries: DataFrame) -> DataFrame:
    """``entries`` with k counted on where an id goes over from one shard to the next; such ids are at most as many as shards."""
    me = F.struct(F.col("id").isNotNull().alias("there"), "id")
    ends = entries.groupBy("shard").agg(F.min(me).alias("low"), F.max(me).alias("high"))
    lows = ends.select("low", F.col("shard").alias("later"))
    highs = ends.select(F.col("high").alias("end"), "shard")
    split = highs.join(lows, (F.col("end") == F.col("low")) & (F.col("later") > F.col("shard"))).select("end").distinct()
    here = entries.select(me.alias("me"), "shard").join(split, F.col("me") == F.col("end"), "left_semi").groupBy("me", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("me").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = here.select("me", F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("more"))
    return (entries.join(offsets, (me == F.col("me")) & (F.col("shard") == F.col("s")), "left")
            .select("shard", "id", (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"), "offset", "n"))


# -- index ----------------------------------------------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on all input bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: pa.Array, k: np.ndarray) -> np.ndarray:
    """One 64-bit number for each key; different for different ids with the same k."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    x = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return _mix(x, 0) ^ _mix(k.astype(np.uint64) * np.uint64(2) + null, 1)


def _positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (_mix(hashes, 2 + level) % np.uint64(bits)).astype(np.int64)


def build_mph(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bit arrays of the levels, the hashes that no level took, and each key's slot."""
    left = np.arange(len(hashes))
    levels, slots, base = [], np.zeros(len(hashes), np.int64), 0
    for level in range(_LEVELS):
        words = max(1, -(-2 * len(left) // 64))
        at = _positions(hashes[left], level, words * 64)
        wanted = np.bincount(at, minlength=words * 64)
        alone = wanted == 1
        took = alone[at]
        rank = np.cumsum(alone)
        slots[left[took]] = base + rank[at[took]] - 1
        base += int(rank[-1])
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~took]
    rest = hashes[left]
    order = np.argsort(rest)
    slots[left[order]] = base + np.arange(len(rest))
    return levels, rest[order], slots


def find_slots(hashes: np.ndarray, levels: list[np.ndarray], ranks: list[np.ndarray], rest: np.ndarray,
               base: int) -> np.ndarray:
    """Slots; -1 where no level and no listed hash has the key. base: keys placed by the levels."""
    slots = np.full(len(hashes), -1, np.int64)
    left = np.arange(len(hashes))
    for level, words in enumerate(levels):
        at = _positions(hashes[left], level, len(words) * 64)
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        slots[left[hit]] = ranks[level][at[hit] >> 6] + np.bitwise_count(below)
        left = left[~hit]
    if len(rest) and len(left):
        at = np.minimum(np.searchsorted(rest, hashes[left]), len(rest) - 1)
        same = rest[at] == hashes[left]
        slots[left[same]] = base + at[same]
    return slots


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 40) >> np.uint64(32)).astype("<u4")


_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4")])


def _index_file(table: pa.Table) -> Iterator[bytes]:
    hashes = key_hash(table.column("id").combine_chunks(), table.column("k").to_numpy())
    levels, rest, slots = build_mph(hashes)
    rows = np.zeros(len(hashes), _SLOT)
    rows["print"][slots] = fingerprint(hashes)
    for name in ("shard", "offset", "n"):
        rows[name][slots] = table.column(name).to_numpy()
    head = [_MAGIC, len(hashes), len(rest)] + [len(x) for x in levels]
    yield np.array(head, "<u8").tobytes()
    for x in [*levels, rest]:
        yield x.astype("<u8").tobytes()
    yield rows.tobytes()


class Index:
    """One index part, read from its file."""

    def __init__(self, folder: str, part: int) -> None:
        fs, base = file_system(folder)
        with fs.open_input_file(f"{base}/index-{part:06d}.mph") as f:
            raw = f.read()
        head = np.frombuffer(raw, "<u8", 3 + _LEVELS)
        if head[0] != _MAGIC:
            raise ValueError("no index file")
        at, self.levels, self.ranks, rank = 8 * len(head), [], [], 0
        for words in head[3:].tolist():
            level = np.frombuffer(raw, "<u8", words, at)
            sums = rank + np.concatenate([[0], np.cumsum(np.bitwise_count(level), dtype=np.int64)])
            self.levels.append(level)
            self.ranks.append(sums[:-1])
            rank, at = int(sums[-1]), at + 8 * words
        self.base, self.rest = rank, np.frombuffer(raw, "<u8", int(head[2]), at)
        self.rows = np.frombuffer(raw, _SLOT, int(head[1]), at + 8 * int(head[2]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for keys that are not stored."""
        slots = find_slots(hashes, self.levels, self.ranks, self.rest, self.base)
        known = np.flatnonzero(slots >= 0)
        slots[known[self.rows["print"][slots[known]] != fingerprint(hashes[known])]] = -1
        return slots


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.lit(-1)), "k"), F.lit(parts)).cast("int")


def build_index(entries: DataFrame, folder: str, part_keys: int = PART_KEYS) -> int:
    """Write one index file for each part of the keys; their number."""
    parts = max(1, -(-entries.count() // part_keys))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        put_file(folder, f"index-{key[0].as_py():06d}.mph", _index_file(table))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([table.num_rows], pa.int64())})

    (entries.withColumn("part", _part(parts)).groupBy("part").applyInArrow(build, "part int, keys long")
     .write.parquet(f"{folder}/parts"))
    return parts


# -- reading --------------------------------------------------------------------------------------

def read_ids(keys: DataFrame, folder: str, parts: int, dtype: str = "<u2", with_ids: bool = True) -> DataFrame:
    """For each key that is stored: id, k, shard, offset, n_tokens, crc32 of the ids as uint32, and the ids.

    Keys meet their index part in one task, then the places found are read in
    order of each shard.
    """
    def find(key: tuple, table: pa.Table) -> pa.Table:
        hashes = key_hash(table.column("id").combine_chunks(), table.column("k").to_numpy())
        index = Index(folder, key[0].as_py())
        slots = index.find(hashes)
        there = slots >= 0
        rows = index.rows[slots[there]]
        found = table.select(["id", "k"]).filter(pa.array(there))
        return pa.table({"shard": pa.array(rows["shard"].astype(np.int32)), "id": found.column("id"), "k": found.column("k"),
                         "offset": pa.array(rows["offset"].astype(np.int64)), "n": pa.array(rows["n"].astype(np.int32))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        shard, file, width = None, None, np.dtype(dtype).itemsize
        for batch in batches:
            crc, ids, n = [], [], batch.column("n").to_numpy()
            for s, o, m in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), n.tolist()):
                if s != shard:
                    if file is not None:
                        file.close()
                    shard, file = s, fs.open_input_file(f"{base}/shard-{s:06d}.ids")
                file.seek(o * width)
                row = np.frombuffer(file.read(m * width), dtype).astype("<u4")
                crc.append(zlib.crc32(row.tobytes()))
                if with_ids:
                    ids.append(row.astype(np.int32))
            out = [batch.column("id"), batch.column("k"), batch.column("shard"), batch.column("offset"),
                   pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids,
                                             names=names)
        if file is not None:
            file.close()

    kind = "id long, k int, shard int, offset long, n_tokens long, crc32 long" + ", ids array<int>" * with_ids
    names = T.StructType.fromDDL(kind).names
    places = keys.withColumn("part", _part(parts)).groupBy("part").applyInArrow(find, _ENTRY)
    return places.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(read, kind)


def starts(entries: DataFrame) -> DataFrame:
    """For each shard, the ids in all shards before it."""
    sizes = entries.groupBy("shard").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))


def write_corpus(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, int]:
    """Shards and index below ``folder``; the places of all documents and the number of index parts."""
    entries = encode_shards(docs, folder, tokenizer, id_col, text_col)
    return entries, build_index(entries, folder)


def round_trip(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus and read every document back by key: id, k, start, n_tokens, crc32."""
    entries, parts = write_corpus(docs.sparkSession, docs, folder, tokenizer, id_col, text_col)
    found = read_ids(entries.select("id", "k"), folder, parts, with_ids=False)
    return (found.join(starts(entries), "shard")
            .select("id", "k", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "crc32"))
