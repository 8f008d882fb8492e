"""Toxicity scores from a counterfactually regularised classifier.

Features of a text are its words, their beginnings and their endings, each
present or not; all that tell the classes apart on the training rows, by a test
that is the same for every feature (``LEAST_ROWS``, ``LEAST_SPREAD``), make the
vocabulary, however many they are. Weights come from logistic regression with a second
penalty: every training text that names a group is written again with another
group of the same kind in its place, and the squared difference of the two
scores is added to the loss, so that naming a group can't make a text toxic
by itself.

Training takes ``SAMPLE_ROWS`` labelled rows at most, drawn by a hash of the
id among the rows that the caller gives; counting features and scoring run on
all executors, and the driver gets the vocabulary and the sample's features in
it. A text is scored whole. A null or empty text has no feature and gets the
score of the bias; a label that is null, or whose id is null, teaches nothing;
of an id with several labels the largest counts, and of an id with several
texts all: ids are taken in the order of their hashes, each with all of its
texts, as long as these are at most ``SAMPLE_ROWS`` together; an id with more
texts than that is passed over. Without a label of either class the score is
the share of the one that there is, or 0, and an empty table gives an empty
result. Texts may be as long as a row can be: one beyond the size of a block is
a block of its own. Only the named columns are read, so others may be called
anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagemill.llm.decontam import words_of
from pagemill.llm.store import in_blocks, shared_dir, written

#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 20_000
#: Texts that a feature must be in, and standard deviations by which its shares in the two classes must differ.
LEAST_ROWS = 5
LEAST_SPREAD = 3.0
#: Weights of the penalties on weights and on score changes.
RIDGE, CHANGE = 1e-4, 4.0
STEPS = 400
_PART = 1 << 20
#: Words that name groups of one kind; each may stand for the next one of its kind.
GROUPS = (
    ("men", "women"), ("man", "woman"), ("boys", "girls"), ("male", "female"), ("gay", "straight"), ("transgender", "cisgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("african", "european", "american"),
    ("immigrants", "natives"), ("disabled", "abled"), ("young", "old"))


def swaps(groups: tuple[tuple[str, ...], ...] = GROUPS) -> dict[str, str]:
    return {word: group[(i + 1) % len(group)] for group in groups for i, word in enumerate(group)}


# -- features -------------------------------------------------------------------------------------

def features_of(word: str) -> list[str]:
    """The word, its beginnings of three to six letters and its endings of four and five."""
    out = ["=" + word]
    out += ["<" + word[:n] for n in (3, 4, 5, 6) if len(word) > n]
    out += [">" + word[-n:] for n in (4, 5) if len(word) > n]
    return out


def _distinct(rows: np.ndarray, codes: np.ndarray, signs: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows.astype(np.int64) * max(signs, 1) + codes)
    return both // max(signs, 1), both % max(signs, 1)


def _words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of the texts in lower case, and the (text, word) pairs that there are."""
    words, counts = words_of(column)
    coded = words.dictionary_encode()
    lowered = pc.utf8_lower(coded.dictionary).dictionary_encode()
    codes = lowered.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    terms = lowered.dictionary.to_pylist()
    rows, codes = _distinct(np.repeat(np.arange(len(counts)), counts), codes, len(terms))
    return terms, rows, codes


def _expanded(rows: np.ndarray, codes: np.ndarray, lists: list[list[int]], signs: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs from (text, word) pairs and the features of each word."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for y in lists for x in y), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    used = sizes[codes] > 0
    rows, codes = rows[used], codes[used]
    n = sizes[codes]
    ends = np.cumsum(n)
    at = np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(starts[codes], n)
    return _distinct(np.repeat(rows, n), flat[at], signs)


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n0, n1: in how many texts of either label it is. ``rows``: text, label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            label = batch.column("label").to_numpy()
            terms, row, code = _words(batch.column("text"))
            number: dict[str, int] = {}
            lists = [[number.setdefault(f, len(number)) for f in features_of(t)] for t in terms]
            row, feature = _expanded(row, code, lists, len(number))
            ones = np.bincount(feature, label[row], minlength=len(number)).astype(np.int64)
            every = np.bincount(feature, minlength=len(number))
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(every - ones), pa.array(ones)],
                                             names=["feature", "n0", "n1"])

    parts = rows.mapInArrow(count, "feature string, n0 long, n1 long")
    return parts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def vocabulary(counts: DataFrame, zeros: int, ones: int, groups=GROUPS) -> list[str]:
    """All features whose shares in the two classes differ for their number of rows; group words always."""
    p0, p1 = F.col("n0") / max(zeros, 1), F.col("n1") / max(ones, 1)
    every = (F.col("n0") + F.col("n1")) / max(zeros + ones, 1)
    spread = F.sqrt(every * (1.0 - every) * (1.0 / max(zeros, 1) + 1.0 / max(ones, 1)) + 1e-12)
    best = (counts.where(F.col("n0") + F.col("n1") >= LEAST_ROWS).select("feature", F.abs((p1 - p0) / spread).alias("z"))
            .where(F.col("z") > LEAST_SPREAD).orderBy(F.desc("z"), "feature").collect())
    named = ["=" + w for w in sorted(swaps(groups))]
    return list(dict.fromkeys([r["feature"] for r in best] + named))


class Features:
    """The vocabulary's features of whole texts."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.number = {f: i for i, f in enumerate(names)}
        self.known: dict[str, list[int]] = {}

    def of(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[word] = [self.number[f] for f in features_of(word) if f in self.number]
        return found

    def pairs(self, column: pa.Array, swap: dict[str, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once, in order; with ``swap`` of the texts with these words replaced."""
        terms, rows, codes = _words(column)
        return _expanded(rows, codes, [self.of(swap.get(t, t) if swap else t) for t in terms], len(self.names))


# -- training -------------------------------------------------------------------------------------

@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float


def _sums(to: np.ndarray, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values[of]`` by ``to``, a part at a time, so that no copy of all pairs is made."""
    total = np.zeros(n)
    for i in range(0, len(to), _PART):
        total += np.bincount(to[i:i + _PART], values[of[i:i + _PART]], minlength=n)
    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(names: list[str], labels: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], swapped: tuple[np.ndarray, np.ndarray],
        ridge: float = RIDGE, change: float = CHANGE, steps: int = STEPS) -> Model:
    """Logistic regression with balanced classes; ``swapped`` has the features of the rewritten texts, of texts that change."""
    n, m = len(labels), len(names)
    ones = float(labels.sum())
    if n == 0 or ones in (0.0, float(n)):
        return Model(names, np.zeros(m), 0.0 if n == 0 else (40.0 if ones else -40.0))
    share = np.where(labels == 1, 0.5 / ones, 0.5 / (n - ones))
    (row, feature), (row2, feature2) = pairs, swapped
    changed, row2 = np.unique(row2, return_inverse=True)  # rows with a rewritten text, and their places among these
    row2 = row2.astype(np.int32)
    w, b = np.zeros(m), 0.0
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):
        s = _sigmoid(_sums(row, feature, w, n) + b)
        d = share * (s - labels)
        grad = ridge * w
        bias = 0.0
        if len(changed):
            s1, s2 = s[changed], _sigmoid(_sums(row2, feature2, w, len(changed)) + b)
            both = 2 * change * (s1 - s2) / len(changed)
            d[changed] += both * s1 * (1 - s1)
            d2 = -both * s2 * (1 - s2)
            grad = grad + _sums(feature2, row2, d2, m)
            bias = d2.sum()
        grad = np.append(grad + _sums(feature, row, d, m), d.sum() + bias)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = 0.05 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(names, w, b)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, seed: int) -> DataFrame:
    """text and label of the sample, written once. Its ids and texts are at most ``rows`` each, so ids are broadcast."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    drawn = F.broadcast(known.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(rows))
    fitting = (docs.select(F.col(id_col).alias("d")).join(drawn, F.col("d") == F.col("i")).groupBy("i")
               .agg(F.first("label").alias("label"), F.count("*").alias("n")).where(F.col("n") <= rows))
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("i", F.lit(seed)), "i"))  # over ``rows`` ids at most
    taken = F.broadcast(fitting.select("i", "label", so_far.alias("so_far")).where(F.col("so_far") <= rows))
    texts = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(
        taken, F.col("d") == F.col("i")).select("text", F.col("label").cast("long").alias("label"))
    return written(texts, shared_dir(docs.sparkSession, "toxicity"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows: int = SAMPLE_ROWS, groups: tuple[tuple[str, ...], ...] = GROUPS, change: float = CHANGE, seed: int = 1) -> Model:
    """Fit the classifier on ``labels`` (id_col, label_col) and the texts of ``docs``; held-out rows are left out by the caller."""
    sample = sampled(docs, labels, id_col, text_col, label_col, rows, seed)
    zeros, ones = sample.agg(F.sum(1 - F.col("label")), F.sum("label")).first()
    names = vocabulary(feature_counts(sample), zeros or 0, ones or 0, groups=groups)
    swap = swaps(groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(names)
        for batch in in_blocks(batches, "text"):
            n, text = batch.num_rows, batch.column("text")
            plain, other = features.pairs(text), features.pairs(text, swap)
            m = len(names)
            moved = np.unique(np.setxor1d(plain[0] * m + plain[1], other[0] * m + other[1]) // m)
            kept = np.isin(other[0], moved)
            lists = []
            for row, feature in (plain, (other[0][kept], other[1][kept])):
                ends = np.searchsorted(row, np.arange(n + 1))
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], names=["label", "plain", "swapped"])

    table = sample.mapInArrow(work, "label long, plain array<int>, swapped array<int>").toArrow()
    pairs = []
    for name in ("plain", "swapped"):
        rows_, features_, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
        for chunk in table.column(name).chunks:
            rows_.append((pc.list_parent_indices(chunk).to_numpy(zero_copy_only=False) + at).astype(np.int32))
            features_.append(chunk.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
            at += len(chunk)
        pairs.append((np.concatenate(rows_), np.concatenate(features_)))
    return fit(names, table.column("label").to_numpy().astype(float), pairs[0], pairs[1], change=change)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row; the weights are those of the vocabulary, which is made from the sample."""
    used = np.flatnonzero(model.weights)
    names, weights, bias = [model.names[i] for i in used], model.weights[used], model.bias

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(names)
        for batch in in_blocks(batches, "text"):
            rows, found = features.pairs(batch.column("text"))
            scores = _sigmoid(_sums(rows, found, weights, batch.num_rows) + bias)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))
