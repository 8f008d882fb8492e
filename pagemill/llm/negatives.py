"""Hard negatives by exact inner products, scored the Four-Russians way.

Vectors are scaled to integers. The dimensions are cut into groups of eight,
and for each group an anchor gets a table of its 256 subset sums. A candidate's
components are split into bit planes (two's complement), the eight bits of a
group and plane packed into a byte. A score is then, plane by plane, the sum of
the table entries at the candidate's bytes, shifted by the plane's place: no
multiplication, and exactly the inner product.

All anchors of a pass lie side by side in the tables, so one look-up serves
them all. Every pass sends a bounded number of anchors (``PASS_BYTES``) to the
tasks and reads all candidates twice: for the anchors' positives, then, with the
positives' scores as limits, for the negatives. A task keeps its best ``k`` rows
per anchor, and those of all tasks are ranked by a window.

Results for odd input: rows with a null label, a null vector or a null or
non-finite component take no part. Vectors of different length are filled up
with zeros. A null id comes last among equal scores, rows that repeat an id are
rows of their own, an anchor is only not its own positive; rows equal in score
and id are ranked in the order in which they were stored. Scores are exact while
they stay below 2^59. An empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.store import shared_dir, written

POSITIVES = 5
NEGATIVES = 5
#: A negative scores from this many hundredths of its positive's score up to all of it.
FLOOR_PERCENT = 80
SCALE = 256
#: Vectors of anchors sent to the tasks at a time; a larger set of anchors takes several passes.
PASS_BYTES = 4 << 20
#: Candidates scored against anchors at a time inside a task.
_CANDIDATES, _ANCHORS = 2048, 128
_LEAST = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), id, label and the vector in integers of the rows that take part."""
    x = F.col(vector_col)
    sound = label.isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    found = rows.where(sound).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                                     F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("vector"))
    return found.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector")


# -- scoring --------------------------------------------------------------------------------------

def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of at least ``width`` components, in whole groups of eight."""
    lists = column.cast(pa.large_list(pa.int64()))
    counts = np.diff(lists.offsets.to_numpy())
    width = -(-max(width, int(counts.max(initial=1)), 1) // 8) * 8
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < counts[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def subset_tables(anchors: np.ndarray) -> np.ndarray:
    """For each group of eight dimensions and each byte the sums of the anchors' components at its set bits: [group, 256, anchor]."""
    count, width = anchors.shape
    groups = anchors.reshape(count, width // 8, 8).transpose(1, 2, 0)  # group, bit, anchor
    tables = np.zeros((width // 8, 256, count), np.int64)
    for bit in range(8):  # entries with this bit as the highest
        tables[:, 1 << bit:2 << bit] = tables[:, :1 << bit] + groups[:, bit, None]
    return tables


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """The candidates' bits as bytes: [plane, group, candidate]; the last plane is that of the sign."""
    top = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)) - 1)
    planes = top.bit_length() + 1
    bits = (vectors[None] >> np.arange(min(planes, 64))[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1)


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor] from subset sums and bit planes."""
    out = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for place, plane in enumerate(planes):
        part = np.take(tables[0], plane[0], axis=0)
        for group in range(1, len(plane)):
            part += np.take(tables[group], plane[group], axis=0)
        if place == len(planes) - 1:
            out -= part << place
        else:
            out += part << place
    return out


def _narrow(tables: np.ndarray, anchors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """32-bit tables where no score can leave them."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << len(planes)
    return tables.astype(np.int32) if most < 1 << 30 else tables


class Best:
    """The first k (score, id, row) of each list, over all blocks seen."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.score = np.full((lists, k), _LEAST)
        self.id = np.full((lists, k), _NO_ID)
        self.row = np.full((lists, k), -1)

    def add(self, at: slice | np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """score: [list, candidate], _LEAST where it doesn't count; ids ascending, equal ids by row."""
        if not score.shape[1]:
            return
        lists, count = score.shape
        k = min(self.k, count)
        limit = np.partition(score, count - k, axis=1)[:, count - k]
        # all above the k-th score, then the first of those equal to it
        above = score > limit[:, None]
        equal = (score == limit[:, None]) & (limit != _LEAST)[:, None]
        room = k - above.sum(axis=1)
        equal &= np.cumsum(equal, axis=1) <= room[:, None]
        where, which = np.nonzero(above | equal)
        if not len(where):
            return
        place = np.arange(len(where)) - np.searchsorted(where, where)
        new = [np.full((lists, k), fill) for fill in (_LEAST, _NO_ID, -1)]
        for part, values in zip(new, (score[where, which], ids[which], rows[which])):
            part[where, place] = values
        both = [np.concatenate([old[at], part], axis=1) for old, part in zip((self.score, self.id, self.row), new)]
        order = np.lexsort((both[2], both[1], ~both[0]), axis=1)[:, :self.k]
        for old, part in zip((self.score, self.id, self.row), both):
            old[at] = np.take_along_axis(part, order, axis=1)

    def batch(self) -> pa.RecordBatch:
        lists, place = np.nonzero(self.score != _LEAST)
        ids = self.id[lists, place]
        return pa.RecordBatch.from_arrays(
            [pa.array(lists), pa.array(self.row[lists, place]), pa.array(ids, mask=ids == _NO_ID), pa.array(self.score[lists, place])],
            names=["list", "row", "id", "score"])


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "list long, row long, id long, score long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Candidates in blocks by ascending id: ids, rows, labels, vectors."""
    for batch in batches:
        for i in range(0, batch.num_rows, _CANDIDATES):
            part = batch.slice(i, _CANDIDATES)
            ids = part.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            rows = part.column("row").to_numpy(zero_copy_only=False)
            order = np.lexsort((rows, ids))
            yield (ids[order], rows[order], part.column("label").to_numpy(zero_copy_only=False)[order],
                   part.column("vector").take(pa.array(order)))


def _search(candidates: DataFrame, anchors: np.ndarray, labels: np.ndarray, own: np.ndarray, k: int,
            limits: np.ndarray | None, floor: int) -> DataFrame:
    """The best rows of each list that the tasks find, a list for each anchor, or with limits for each anchor and positive.

    Without limits rows of the anchor's label but itself; with limits [anchor,
    positive] rows of other labels from ``floor`` hundredths of the limit up to it.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors) * (1 if limits is None else limits.shape[1]), k)
        for ids, rows, label, vectors in _blocks(batches):
            found = matrix(vectors, anchors.shape[1])
            planes = bit_planes(found)
            for i in range(0, len(anchors), _ANCHORS):
                some = slice(i, min(i + _ANCHORS, len(anchors)))
                here = np.pad(anchors[some], ((0, 0), (0, found.shape[1] - anchors.shape[1])))
                got = scores(_narrow(subset_tables(here), here, planes), planes).T.astype(np.int64)
                same = labels[some, None] == label[None]
                if limits is None:
                    fits = same & (own[some, None] != rows[None])
                    best.add(some, np.where(fits, got, _LEAST), ids, rows)
                    continue
                for j in range(limits.shape[1]):
                    limit = limits[some, j, None]
                    fits = ~same & (limit != _LEAST) & (got <= limit) & (100 * got >= floor * limit)
                    kept = np.flatnonzero(fits.any(axis=0))
                    lists = np.arange(some.start, some.stop) * limits.shape[1] + j
                    best.add(lists, np.where(fits, got, _LEAST)[:, kept], ids[kept], rows[kept])
        yield best.batch()

    found = candidates.mapInArrow(work, _FOUND)
    order = Window.partitionBy("list").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR_PERCENT, scale: int = SCALE,
                   pass_bytes: int = PASS_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on the column ``id``.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark, "negatives")
    label = F.col("label") if label is None else label
    candidates = written(prepared(rows, id_col, vector_col, label, scale), f"{folder}/candidates")
    asked = written(candidates.where(anchor).withColumn("width", F.size("vector")), f"{folder}/anchors")
    total, widest = asked.agg(F.count("*"), F.max("width")).first()
    size = max(1, pass_bytes // (8 * max(widest or 1, 1)))
    numbered = _numbered(asked, size, total, folder)
    paths = []
    for number in range(-(-total // size)):
        taken = numbered.where(F.col("pass") == number).drop("pass", "width").toArrow().combine_chunks()  # size rows at most
        column = lambda name: taken.column(name).combine_chunks()
        anchors = matrix(column("vector"), 1)
        labels, own = column("label").to_numpy(), column("row").to_numpy()
        best = written(_search(candidates, anchors, labels, own, positives, None, floor), f"{folder}/positives-{number}")
        limits = np.full((len(anchors), positives), _LEAST)
        known = best.select("list", "rank", "score", "id").toArrow()  # size x positives rows at most
        lists, ranks = known.column("list").to_numpy(), known.column("rank").to_numpy() - 1
        limits[lists, ranks] = known.column("score").to_numpy()
        found = _search(candidates, anchors, labels, own, negatives, limits, floor)
        names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(anchors))), "anchor_id": column("id")}),
                                      "anchor long, anchor_id long")
        given = best.join(F.broadcast(names), F.col("list") == F.col("anchor")).select(
            (F.col("list") * positives + F.col("rank") - 1).alias("list"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = found.select("list", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(given, "list")
        paths.append(f"{folder}/found/pass-{number}")
        written(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), paths[-1])
    return spark.read.schema(_RESULT).parquet(*paths) if paths else spark.createDataFrame([], _RESULT)


def _numbered(asked: DataFrame, size: int, total: int, folder: str) -> DataFrame:
    """The anchors with the number of their pass, ``size`` rows in each; nothing but counts per stored part meets in one place."""
    if total <= size:
        return asked.withColumn("pass", F.lit(0))
    part = F.shiftright("row", 33)  # the part of the table that the row was numbered in
    counts = asked.groupBy(part.alias("part")).agg(F.count("*").alias("count"))
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy(part).orderBy("row")) - 1
    rows = asked.withColumn("part", part).withColumn("place", place).join(before, "part")
    return written(rows.withColumn("pass", F.floor((F.col("before") + F.col("place")) / size)).drop("part", "place", "before"), f"{folder}/numbered")
