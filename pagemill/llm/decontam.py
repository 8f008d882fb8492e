"""Benchmark decontamination with a positional inverted index over the training texts.

``build_index`` stores, for blocks of documents, every term with the positions
of all its occurrences. ``find`` answers windows of benchmark words from these
postings: it starts at the rarest term of a window, shifts the lists by the
place of their term in the window and intersects them, rarest first. A block
holds whole documents, so neither step moves texts between tasks.

Words are runs of ASCII letters and digits and of all characters beyond ASCII;
A-Z count as a-z. A null or empty text has no words and no matches. Rows that
repeat an id are answered one by one. Only the id and the text column are
read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.store import in_blocks, ragged, shared_dir, spans_of, text_bytes, written

WINDOW = 10
#: Query words sent to the tasks at once; a larger benchmark is asked for in several passes over the index.
PASS_WORDS = 250_000
#: Candidate places handled at a time inside a task.
CANDIDATES = 1 << 19

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and how many each text has."""
    data, offsets = text_bytes(column)
    inside = _WORD[data]
    # a word ends with its text: look at the change of class and at the text borders
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    joined = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(joined)])
    return words, counts


# -- index ----------------------------------------------------------------------------------------

def _index_type(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("block", T.StringType()),
        T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        # positions in the block, by term and then ascending, each as the difference to the one before (int32)
        T.StructField("postings", T.BinaryType()),
    ])


def _block(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, n_words = words_of(batch.column("text"))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    terms = coded.dictionary
    if len(terms) < 1 << 16:
        codes = codes.astype(np.uint16)  # sorted by radix
    positions = np.argsort(codes, kind="stable").astype(np.int32)
    row = [pa.array([uuid.uuid4().hex]),
           pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")),
           pa.array([n_words.astype(np.int32)], pa.list_(pa.int32())),
           pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.string())),
           pa.array([np.bincount(codes, minlength=len(terms)).astype(np.int32)], pa.list_(pa.int32())),
           pa.array([np.diff(positions, prepend=np.int32(0)).astype("<i4").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(row, names=["block", "ids", "n_words", "terms", "counts", "postings"])


def build_index(docs: DataFrame, id_col: str, path: str, text_col: str = "text") -> DataFrame:
    """Write the postings of all words of all texts below ``path``; one row per block of documents."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_block, in_blocks(batches, "text"))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(blocks, _index_type(rows.schema["id"].dataType)), path, group_rows=1)


# -- queries --------------------------------------------------------------------------------------

def windows_of(items: list[tuple[str, list[str]]], size: int = WINDOW) -> dict[tuple[str, ...], list[str]]:
    """Each distinct window of words with the items that have it; an item of fewer words is one window."""
    windows: dict[tuple[str, ...], dict[str, None]] = {}
    for item, words in items:
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i:i + size]), {})[item] = None
    return {k: list(v) for k, v in windows.items()}


class Query:
    """Windows as a matrix of term numbers, padded with -1."""

    def __init__(self, windows: dict[tuple[str, ...], list[str]], slop: int = 0) -> None:
        vocabulary = sorted({t for w in windows for t in w})
        number = {t: i for i, t in enumerate(vocabulary)}
        self.terms, self.slop = pa.array(vocabulary, pa.string()), slop
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.matrix = np.full((len(windows), int(self.lengths.max(initial=1))), -1, np.int64)
        for i, w in enumerate(windows):
            self.matrix[i, :len(w)] = [number[t] for t in w]
        self.items = list(windows.values())


def _matches(query: Query, terms: pa.Array, counts: np.ndarray, positions: np.ndarray,
             borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, their first places and documents. borders: where documents start, and the end of the last."""
    place = pc.index_in(query.terms, value_set=terms).to_numpy(zero_copy_only=False)
    place = np.where(np.isnan(place), -1, place).astype(np.int64) if place.dtype.kind == "f" else place.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    padded = query.matrix < 0
    local = np.where(padded, -1, place[query.matrix])
    sizes = np.where(local < 0, 0, counts[local])
    alive = np.flatnonzero((padded | (sizes > 0)).all(axis=1))
    none = np.zeros(0, np.int64)
    if not len(alive):
        return none, none, none
    # postings as one sorted list of (term, position)
    keys = np.repeat(np.arange(len(counts), dtype=np.int64) << 32, counts) + positions
    local, sizes = local[alive], np.where(padded[alive], np.iinfo(np.int64).max, sizes[alive])
    order = np.argsort(sizes, axis=1, kind="stable")
    rarest = order[:, 0]
    shifts = np.arange(-query.slop, query.slop + 1)
    n = sizes[np.arange(len(alive)), rarest] * len(shifts)
    found = []
    begin, ends = 0, np.cumsum(n)
    while begin < len(alive):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CANDIDATES, side="right")))
        rows = np.arange(begin, stop)
        begin = stop
        term = local[rows, rarest[rows]]
        w = np.repeat(rows, counts[term])
        anchor = positions[ragged(starts[term], counts[term])].astype(np.int64)
        doc = np.searchsorted(borders, anchor, side="right") - 1
        w, doc = np.repeat(w, len(shifts)), np.repeat(doc, len(shifts))
        s = np.repeat(anchor, len(shifts)) - rarest[w] + np.tile(shifts, len(anchor))
        low, high = borders[doc], borders[doc + 1] - 1
        for j in range(1, order.shape[1]):
            off = order[w, j]
            term = local[w, off]
            some = term >= 0
            base, at = term << 32, s + off
            least = base + np.maximum(at - query.slop, low)
            i = np.searchsorted(keys, least)
            ok = keys[np.minimum(i, len(keys) - 1)] <= base + np.minimum(at + query.slop, high)
            keep = np.flatnonzero(~some | ok & (i < len(keys)) & (at - query.slop <= high) & (at + query.slop >= low))
            w, s, doc, low, high = w[keep], s[keep], doc[keep], low[keep], high[keep]
            if not len(w):
                break
        found.append(np.stack([alive[w], s, doc]))
    every = np.concatenate(found, axis=1)
    return tuple(np.unique(every, axis=1) if query.slop and every.size else every)


def _answers(batch: pa.RecordBatch, query: Query, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for row in range(batch.num_rows):
        cell = lambda name: batch.column(name)[row]  # noqa: B023, E731
        ids, n_words = cell("ids").values, cell("n_words").values.to_numpy()
        borders = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
        counts = cell("counts").values.to_numpy().astype(np.int64)
        positions = np.cumsum(np.frombuffer(cell("postings").as_buffer(), "<i4"), dtype=np.int64)
        w, s, doc = _matches(query, cell("terms").values, counts, positions, borders) if len(counts) else (positions,) * 3
        spans: list[list[dict]] = [[]] * len(ids)
        items: list[list[str]] = [[]] * len(ids)
        if len(w):
            total = int(borders[-1])
            low = np.maximum(s, borders[doc])
            high = np.maximum(low, np.minimum(s + query.lengths[w], borders[doc + 1]))
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, low, 1)
            np.add.at(cover, high, -1)
            hit = np.cumsum(cover)[:-1] > 0
            for d in np.unique(doc):
                begin, end = spans_of(hit[borders[d]:borders[d + 1]])
                spans[d] = [{"start": int(a), "end": int(b)} for a, b in zip(begin, end)]
                items[d] = sorted({x for k in np.unique(w[doc == d]) for x in query.items[k]})
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([cell("block").as_py()] * len(ids)), pa.array(range(len(ids)), pa.int32()), ids.cast(id_type),
             pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
            names=["block", "row", "id", "n_words", "spans", "items"])


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Item ids as text with the words of the item."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = words_of(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.ListArray.from_arrays(offsets, words.cast(pa.string()))], names=["item", "words"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                        F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(split, "item string, words array<string>")


def find(index: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0,
         pass_words: int = PASS_WORDS) -> DataFrame:
    """Every indexed document with the items found in it: id, n_words, spans (of words, end exclusive), items.

    ``items`` is a table (item string, words array<string>). ``slop`` 0 finds
    exact phrases. With a larger one a window is near a place when each of its
    terms stands within ``slop`` words of where the phrase would have it; the
    span is then the phrase's place. Items are taken in passes of bounded size
    over the index, and a document's matches of all passes are united. An
    empty set of items matches nothing.
    """
    id_type = index.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("block", T.StringType()), T.StructField("row", T.IntegerType()),
                        T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
                        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                                         T.StructField("end", T.LongType())]))),
                        T.StructField("items", T.ArrayType(T.StringType()))])
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    passes = max(1, -(-total // pass_words))
    results = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k) if passes > 1 else items
        query = Query(windows_of([(r["item"], r["words"]) for r in part.toLocalIterator()], size), slop)
        results.append(index.mapInArrow(_asker(query, id_type), out))
    if passes == 1:
        return results[0].drop("block", "row")
    both = results[0]
    for r in results[1:]:
        both = both.unionByName(r)
    merged = both.groupBy("block", "row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("id", "n_words", "spans", "items")


def _asker(query: Query, id_type: T.DataType) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(id_type)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _answers(batch, query, arrow)
    return ask


def covered(spans: Column) -> Column:
    """Words below spans that are sorted by their start and may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(a["to"], s["start"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """id, n_words, n_hit, items and contaminated for every row of ``docs``."""
    index = build_index(docs, id_col, shared_dir(docs.sparkSession, "postings"), text_col)
    found = find(index, item_words(items, item_col, item_text_col), size, slop)
    hit = covered(F.col("spans"))
    return found.select("id", "n_words", hit.alias("n_hit"), "items", "spans", (F.size("items") > 0).alias("contaminated"))
