"""Spelling variants by k-d trees over letter counts.

Two words one edit apart differ little in their letter counts: a replaced
letter lowers one count and raises another, an inserted one raises one. So the
L1 distance of their counts is two at most, for each pair of lengths with known
signs. Words of a length are points of a k-d tree; a range search goes down
where the least such difference to a node's box is within reach (``REACH``),
and what it finds is verified letter by letter.

The upper part of a tree, one per length with over ``CELL_WORDS`` words, is
fitted on a sample of words (``SAMPLE_WORDS`` per length at most; it decides
the cut between tasks, never what is found). Every word is then a point of one cell and
asks in all cells of its own and the neighbouring lengths that its box reaches. A cell is
one task's work: a tree down to ``LEAF_WORDS`` points, searched by all its
questions at once. A question comes back as a count and its best word, so
pairs are never written.

Words are runs of letters, cut and counted by the JVM. Results for odd input:
a null or empty text has no words, a null id counts as the text "null", rows that repeat are counted
again, an empty table gives no rows. Runs of any length are words. Only the id
and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import ragged, shared_dir, written

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form occurs so many times as often as the word at least.
RATIO = 10
#: Words of a length that one task searches, about, and words that fit the cut of a length into cells.
CELL_WORDS = 8192
SAMPLE_WORDS = 16384
LEAF_WORDS = 24
#: Lengths beyond this are a cell each.
LONGEST = 256
#: How far a count of the point may (rise, fall) against the word that asks, by difference of lengths.
REACH = {0: (1, 1), 1: (1, 0), -1: (0, 1)}
#: Pairs compared at a time inside a task.
_PAIRS = 1 << 18


# -- words ----------------------------------------------------------------------------------------

def misspelt(run: Column, key: Column, every: int = 31) -> Column:
    """The run, without one letter where the checksum of key and run is divisible by ``every``."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, times: int = LEAST_COUNT,
                every: int | None = None) -> DataFrame:
    """word and n of the runs of letters; with ``every`` some of them lose a letter first (``misspelt``)."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    # a run counts per text first: what it becomes depends on text and run only
    word = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select("id", word.alias("run"))
    word = F.col("run") if every is None else misspelt(F.col("run"), F.col("id"), every)
    return rows.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


# -- letter counts and trees ----------------------------------------------------------------------

def spelled(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    length = len(words[0]) if words else 0
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """26 letters, and six sums over the letters beyond ASCII; counts that are summed lie no farther apart than the letters' own."""
    letter = np.where(codes < 128, codes - 97, 26 + codes % 6).astype(np.int64) % 32
    out = np.zeros((len(codes), 32), np.int16)
    for column in letter.T:
        out[np.arange(len(codes)), column] += 1
    return out


def reached(asks: np.ndarray, low: np.ndarray, high: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
    """Which words may have a point within reach in the box."""
    rise = np.maximum(low - asks, 0).sum(axis=1, dtype=np.int32)
    fall = np.maximum(asks - high, 0).sum(axis=1, dtype=np.int32)
    return (rise <= reach[0]) & (fall <= reach[1])


def cut_of(points: np.ndarray) -> tuple[int, int] | None:
    """Dimension and greatest count of the lower half, where the points fall apart most evenly; None if all are equal."""
    spread = np.flatnonzero(points.min(axis=0) != points.max(axis=0))
    if not len(spread):
        return None
    best = None
    for d in spread[np.argsort(-points[:, spread].var(axis=0), kind="stable")[:4]].tolist():
        at = int(np.median(points[:, d]))
        at = at if at < points[:, d].max() else at - 1
        below = int((points[:, d] <= at).sum())
        if best is None or abs(2 * below - len(points)) < best[0]:
            best = abs(2 * below - len(points)), d, at
    return best[1], best[2]


class Cells:
    """The upper part of a tree: cuts fitted on a sample, cells numbered from the left."""

    def __init__(self, sample: np.ndarray, most: int) -> None:
        #: of each node: dimension (-1 for a cell), limit, left and right node or number of the cell
        self.nodes: list[list[int]] = []
        self.count = 0
        self._grow(sample, most)

    def _grow(self, sample: np.ndarray, most: int) -> int:
        number = len(self.nodes)
        self.nodes.append([-1, 0, 0, 0])
        cut = cut_of(sample) if len(sample) > most else None
        if cut is None:
            self.nodes[number][2] = self.count
            self.count += 1
        else:
            lower = sample[:, cut[0]] <= cut[1]
            self.nodes[number][:2] = cut
            self.nodes[number][2] = self._grow(sample[lower], most)
            self.nodes[number][3] = self._grow(sample[~lower], most)
        return number

    def find(self, asks: np.ndarray, reach: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
        """Cells with the words that reach them; with reach (0, 0) each point's own cell."""
        low, high = np.zeros(asks.shape[1], np.int16), np.full(asks.shape[1], np.iinfo(np.int16).max, np.int16)
        todo = [(0, np.arange(len(asks)), low, high)]
        while todo:
            node, which, low, high = todo.pop()
            dim, limit, left, right = self.nodes[node]
            which = which[reached(asks[which], low, high, reach)]
            if not len(which):
                continue
            if dim < 0:
                yield left, which
                continue
            below, above = high.copy(), low.copy()
            below[dim], above[dim] = min(limit, high[dim]), max(limit + 1, low[dim])
            todo += [(left, which, low, below), (right, which, above, high)]


class Tree:
    """A k-d tree over points: of each node its box, its points and its halves (none in a leaf)."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points.astype(np.int8) if points.max(initial=0) < 64 else points
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(points)), -1)]
        halves: dict[int, list[int]] = {}
        while todo:
            here, parent = todo.pop()
            number, box = len(self.nodes), self.points[here]
            halves.setdefault(parent, []).append(number)
            self.nodes.append((here, box.min(axis=0), box.max(axis=0)))
            cut = cut_of(box) if len(here) > LEAF_WORDS else None
            if cut is not None:
                lower = box[:, cut[0]] <= cut[1]
                todo += [(here[lower], number), (here[~lower], number)]
        self.halves = halves

    def pairs_in_reach(self, asks: np.ndarray, reach: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and points within reach of each other by letter counts; all words go down the tree at once."""
        asks = asks.astype(self.points.dtype) if asks.max(initial=0) < 64 else asks
        todo = [(0, np.arange(len(asks)))]
        while todo:
            node, which = todo.pop()
            here, low, high = self.nodes[node]
            which = which[reached(asks[which], low, high, reach)]
            if not len(which):
                continue
            if node in self.halves:
                todo += [(half, which) for half in self.halves[node]]
                continue
            for i in range(0, len(here), 256):  # equal counts can't be cut, so a leaf may be larger
                some = self.points[here[i:i + 256]]
                step = max(1, _PAIRS // (len(some) * 32))
                for j in range(0, len(which), step):
                    gap = some[None] - asks[which[j:j + step], None]
                    rise = np.maximum(gap, 0).sum(axis=2, dtype=np.int16)
                    near = (rise <= reach[0]) & (rise - gap.sum(axis=2, dtype=np.int16) <= reach[1])
                    a, b = np.nonzero(near)
                    if len(a):
                        yield which[j + a], here[i + b]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows are one edit apart; b's words are as long as a's or one letter longer."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= length


# -- the search -----------------------------------------------------------------------------------

def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == length)
        yield length, which, [texts[i] for i in which.tolist()]


def fitted(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> dict[int, Cells]:
    """Cells of each length that has more words than one cell should."""
    size = F.length("word")
    counts = dict(words.where(size <= LONGEST).groupBy(size.alias("size")).count().where(F.col("count") > cell_words).toArrow().to_pandas().values.tolist())
    if not counts:
        return {}
    share = F.coalesce(*(F.when(size == k, F.lit(min(1.0, 0.9 * sample_words / n))) for k, n in counts.items()))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)).select("word").limit(len(counts) * sample_words)
    cells = {}
    for length, _, texts in _by_length(drawn.toArrow().column("word").combine_chunks()):
        most = max(LEAF_WORDS, cell_words * len(texts) // counts[length])
        cells[length] = Cells(letter_counts(spelled(texts)), most)
    return cells


def _routed(words: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """size and cell of every word as a point, and of all cells where it asks (gap: the points' length less its own)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, which, texts in _by_length(batch.column("word")):
                counts = letter_counts(spelled(texts))
                for role, gap, reach in ((0, 0, (0, 0)), *((1, g, r) for g, r in REACH.items())):
                    tree = cells.get(length + gap)
                    for cell, found in tree.find(counts, reach) if tree else [(0, np.arange(len(which)))]:
                        rows = batch.take(pa.array(which[found]))
                        same = lambda v: pa.array(np.full(len(found), v, np.int32))  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([same(length + gap), same(cell), same(role), *rows.columns],
                                                         names=["size", "cell", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(work, "size int, cell int, asks int, word string, n long")


def _searched(table: pa.Table) -> pa.Table:
    """What the questions of a cell find there: word, how many near words, and the most frequent of them."""
    asks, n = table.column("asks").to_numpy(), table.column("n").to_numpy()
    words = np.array(table.column("word").to_pylist(), dtype=object)
    points = np.flatnonzero(asks == 0)
    out = {"word": [], "near": [], "best": [], "best_n": []}
    if len(points):
        points = points[np.lexsort((words[points], -n[points]))]  # most frequent first, then by code points
        length = len(words[points[0]])
        codes = spelled(words[points].tolist())
        tree = Tree(letter_counts(codes))
        for gap, reach in REACH.items():
            who = np.array([i for i in np.flatnonzero(asks == 1).tolist() if len(words[i]) == length - gap], np.int64)
            if not len(who):
                continue
            own = spelled(words[who].tolist())
            near, best = np.zeros(len(who), np.int64), np.full(len(who), len(points))
            for a, b in tree.pairs_in_reach(letter_counts(own), reach):
                for i in range(0, len(a), _PAIRS // max(1, length)):
                    some, others = a[i:i + _PAIRS // max(1, length)], b[i:i + _PAIRS // max(1, length)]
                    hit = one_edit(own[some], codes[others]) if gap >= 0 else one_edit(codes[others], own[some])
                    np.add.at(near, some[hit], 1)
                    np.minimum.at(best, some[hit], others[hit])
            got = np.flatnonzero(near)
            out["word"] += words[who[got]].tolist()
            out["near"] += near[got].tolist()
            out["best"] += words[points[best[got]]].tolist()
            out["best_n"] += n[points[best[got]]].tolist()
    return pa.table({k: pa.array(v, pa.string() if k in ("word", "best") else pa.int64()) for k, v in out.items()})


def near_words(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, n_near, form and form_n (the most frequent near word) of the words that have near ones; ``words`` is a stored table."""
    routed = _routed(words, fitted(words, cell_words))
    found = routed.groupBy("size", "cell").applyInArrow(_searched, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root: the last of the forms that follow from a word. Each round doubles the steps; forms can't form a circle, as their n rises."""
    now, number = written(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0"), 0
    while True:
        number += 1
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("on"))
        moved = now.join(ahead, F.col("root") == F.col("via"), "left")
        now = written(moved.select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), f"{folder}/roots-{number}")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, least: int = LEAST_LETTERS,
                   times: int = LEAST_COUNT, ratio: int = RATIO, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words."""
    folder = shared_dir(docs.sparkSession, "variants")
    words = written(word_counts(docs, id_col, text_col, least, times, every), f"{folder}/words")
    near = near_words(words, cell_words).withColumnRenamed("word", "w")
    rows = words.join(near, F.col("word") == F.col("w"), "left")
    frequent = F.col("form_n") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("form")).alias("form"),
                               F.when(frequent, F.col("form_n")).alias("form_n")), f"{folder}/near")
    found = roots(rows.where("form is not null"), folder).withColumnRenamed("word", "w")
    return rows.join(found, F.col("word") == F.col("w"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
