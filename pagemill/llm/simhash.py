"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits, each the majority over the hashes of all shingles
of a text. Fingerprints are links when at most ``DISTANCE`` bits differ. Of
two such fingerprints one of the two 32-bit segments differs in one bit at
most, so every fingerprint is stored in a table by segment value, looks up
the 33 values of the Hamming ball around each of its own segments, and the
whole distance is verified on what the tables give.

Only different fingerprints are stored and looked up: copies are one row
there, however many. Components of links come from alternating large-star and
small-star steps, each written out, so no lineage grows and nothing but a
count reaches the driver.

Words are runs of anything but ASCII white space, with A-Z as a-z. A text of
fewer words than a shingle is one shingle, a null or empty text has the
fingerprint 0. Null ids take part and never name a component as long as it
has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.store import in_blocks, shared_dir, written

SHINGLE_WORDS = 3
DISTANCE = 3
SEED = 42
SEGMENT_BITS = 32
#: Hashes whose bits are counted at a time.
_SLICE = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of all shingles, repeats included."""
    words = text.encode().lower().split() if text else []  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[size - 1:].tolist()
    begins = [0] + (ends[:len(words) - size] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """A number with the bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = hashes[i:i + _SLICE].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """id, fingerprint (long) and text_hash of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            prints = [majority(shingle_hashes(t.as_py(), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64()), batch.column("text_hash")],
                                             names=["id", "fingerprint", "text_hash"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"))
    kind = T.StructType([rows.schema["id"], T.StructField("fingerprint", T.LongType()), T.StructField("text_hash", T.LongType())])
    return rows.mapInArrow(work, kind)


def _segment(fingerprint: Column, number: int) -> Column:
    return F.shiftrightunsigned(fingerprint, SEGMENT_BITS) if number else fingerprint.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """All pairs a < b of different fingerprints within ``distance`` bits (3 at most); ``prints`` has one column."""
    if distance >= 4:
        raise ValueError("two segments with balls of one bit find distances of 3 at most")
    fp = F.col(prints.columns[0])
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)))
    table = prints.select(fp.alias("b"), F.posexplode(F.array(_segment(fp, 0), _segment(fp, 1))).alias("part", "value"))
    probes = prints.select(fp.alias("a"), F.posexplode(F.array(_segment(fp, 0), _segment(fp, 1))).alias("part", "near"))
    probes = probes.select("a", "part", F.explode(F.transform(ball, lambda x: F.col("near").bitwiseXOR(x))).alias("value"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probes.join(table, (probes["part"] == table["part"]) & (probes["value"] == table["value"])
                       & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root for every node that has an edge; root is the smallest node of its component.

    Large-star links the greater neighbours of a node to its least neighbour,
    small-star the smaller ones; both keep components, and when nothing
    changes every node hangs on its root.
    """
    now, step, seen = written(edges.select("a", "b"), f"{folder}/edges-0"), 0, None
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("least").alias("y"))
        large = large.where("x <> y").distinct()
        smallest = large.groupBy("x").agg(F.min("y").alias("least"))
        small = (large.join(smallest, "x").select(F.col("y").alias("x"), F.col("least").alias("y"))
                 .unionByName(smallest.select("x", F.col("least").alias("y"))).where("x <> y").distinct())
        now = written(small.select(F.col("y").alias("a"), F.col("x").alias("b")), f"{folder}/edges-{step}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = state


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
             distance: int = DISTANCE) -> DataFrame:
    """id, text_hash, fingerprint (long) and root (a fingerprint, the same for a whole component) of every row."""
    folder = shared_dir(docs.sparkSession, "simhash")
    rows = written(fingerprints(docs, id_col, text_col, size), f"{folder}/prints")
    found = components(links(rows.select("fingerprint").distinct(), distance), folder)
    return rows.join(found, rows["fingerprint"] == found["node"], "left").select(
        "id", "text_hash", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint as 16 hex digits and component_id, the smallest id of the component, of every row."""
    rows = clusters(docs, id_col, text_col)
    # per fingerprint first, so that copies are counted before they meet
    names = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    return (rows.join(names, "root").select(
        "id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest id, then the smallest text hash."""
    rows = clusters(docs, id_col, text_col)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")).alias("r"))
    times = rows.groupBy("id", "text_hash").agg(F.count("*").alias("_times"))
    chosen = written(first.select("r.id", "r.text_hash").join(
        times.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "_times"),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).select("i", "h", "_times"),
        shared_dir(docs.sparkSession, "simhash-chosen"))
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"))
    kept = whole.join(chosen.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("i")) & (F.col("_hash") == F.col("h")))
    if not chosen.where("_times > 1").isEmpty():  # rows that repeat both id and text: one of them
        again = kept.where("_times > 1").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
        kept = kept.where("_times = 1").select("_row").unionByName(again.select("_row"))
    return kept.select("_row.*")
