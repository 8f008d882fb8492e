"""Quality rules as a short-circuit cascade.

A rule rejects a document by a Column expression over ``Facts`` of its text:
the words, split once per row for all rules, and what follows from them.
``measure`` times each rule behind that split, as it runs, and counts its
rejections on a sample of bounded size, ``ordered`` sorts the rules by
rejections per cost, and ``verdict`` says the cascade as one CASE: a document
leaves at the first rule that rejects it, and dearer rules aren't evaluated
for it. The order changes the cost alone, never the verdict.

Words are runs of anything but ASCII white space. A null or empty text has no
words; documents of under ``MIN_WORDS`` words are rejected. Rows are judged
one by one, so ties, repeated rows and null ids make no difference, an empty
table gives an empty one, and a text of any length is read whole inside its
row. ``with_signals`` sets the column ``signals`` and ``cascade`` the column
``rejected_by``, also where the input has one of that name; ``kept`` returns
the input's columns, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.common import let
from pagemill.llm.store import shared_dir, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows that costs and selectivities are estimated on.
SAMPLE_ROWS = 2000
WINDOW_WORDS = 8
_SYMBOLS = "#*$%&|<>"
_SHOUT = r"[^\x20\x09-\x0D]!![\x20\x09-\x0D]"
_BLANK = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def n_symbols(text: Column) -> Column:
    plain = text
    for sign in _SYMBOLS:
        plain = F.replace(plain, F.lit(sign))
    return F.coalesce((F.length(text) - F.length(plain)).cast("long"), F.lit(0).cast("long"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                     lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _windows(words: Column) -> Column:
    """A hash for each run of eight words: of pairs, of pairs of these, and once more."""
    def paired(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(F.size(h), F.lit(1))),
                                                lambda x, y: F.xxhash64(x, y)))
    single = F.transform(words, lambda w: F.xxhash64(w))
    return let(paired(paired(paired(single, 1), 2), 4),
               lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW_WORDS - 1), F.lit(0))))


def n_repeat_words(words: Column) -> Column:
    """Words inside windows of eight that the text has twice or more."""
    def starts(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(
            F.sequence(F.lit(0), F.size(p) - 1),
            lambda j: F.get(p, j)["h"].eqNullSafe(F.get(p, j + 1)["h"]) | F.get(p, j)["h"].eqNullSafe(F.get(p, j - 1)["h"])),
            lambda j: F.get(p, j)["i"])))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
        return F.aggregate(at, zero, lambda a, i: F.struct(
            (a["n"] + (i + WINDOW_WORDS - F.greatest(i, a["to"]))).cast("long").alias("n"),
            (i + WINDOW_WORDS).alias("to")), lambda a: a["n"])

    return let(_windows(words), lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(starts(w))).otherwise(F.lit(0).cast("long")))


def _n_lines(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))


#: Every signal as an expression over a text and its words.
SIGNALS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
    "n_lines": lambda t, w: _n_lines(t),
    "n_shouts": lambda t, w: F.coalesce(F.regexp_count(t, F.lit(_SHOUT)), F.lit(0)),
}


class Facts:
    """The signals of a text for rules to read: those in ``known`` as they are, others as expressions."""

    def __init__(self, text: Column, words: Column, known: Mapping[str, Column] | None = None) -> None:
        self.text, self.words, self.known = text, words, known or {}

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else SIGNALS[name](self.text, self.words)


def signals_of(text: Column, names: Iterable[str] = SIGNALS) -> Column:
    """A struct of the signals named; the words are split once."""
    return let(words(text), lambda w: F.struct(*(SIGNALS[n](text, w).alias(n) for n in names)))


def with_signals(docs: DataFrame, text_col: str = "text", names: Iterable[str] = SIGNALS) -> DataFrame:
    """``docs`` with a struct ``signals`` of the signals named."""
    return docs.withColumn("signals", signals_of(F.col(text_col), names))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean Column for the facts of a text; null counts as false."""
    name: str
    rejects: Callable[[Facts], Column]


#: Texts that fail one of the first two are rejected in any case; the others are this cascade's own.
RULES = (
    Rule("few_words", lambda f: f["n_words"] < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]),
    Rule("symbols", lambda f: 5 * f["n_symbols"] > f["n_words"]),
    Rule("shouting", lambda f: 2 * f["n_shouts"] > f["n_words"]),
    Rule("repeated_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
    Rule("long_words", lambda f: f["word_chars"] > 60 * f["n_words"]),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        """Rejections per cost."""
        return self.rejected / max(self.seconds, 1e-9)


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7, **made: Column) -> DataFrame:
    """At most ``rows`` rows drawn from the whole table, with the columns ``made`` of them, written once."""
    total = docs.count()
    part = docs
    if total > rows:  # a few more than asked for, of which chance decides, not the place in the table
        part = docs.sample(fraction=min(1.0, 1.2 * rows / total), seed=seed).orderBy(F.rand(seed)).limit(rows)
    return written(part.withColumns(made), shared_dir(docs.sparkSession, "quality-sample"))


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
            signals: str | None = None) -> list[Estimate]:
    """Cost in seconds and share of rejections of each rule over a sample of ``docs``; a first pass warms up.

    The sample holds what the cascade has at hand, the words or the signals,
    so a rule's cost is what it adds.
    """
    text = F.col("text")
    drawn = docs.select(F.col(text_col).alias("text"))
    if signals:  # made again for the rows drawn: taken from ``docs`` they would be made for all rows before the draw
        sample = sampled(drawn, sample_rows, signals=signals_of(text, docs.schema[signals].dataType.fieldNames()))
        facts = Facts(text, words(text), _known(sample, "signals"))
    else:
        sample = sampled(drawn, sample_rows, words=words(text))
        facts = Facts(text, F.col("words"))
    rows, estimates = sample.count(), []
    for rule in rules:
        query = sample.agg(F.count_if(rule.rejects(facts)))
        query.first()
        begin = time.perf_counter()
        rejected = query.first()[0]
        estimates.append(Estimate(rule, time.perf_counter() - begin, rejected / max(rows, 1)))
    return estimates


def ordered(estimates: list[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.gain, e.seconds, e.rule.name))]


def _known(docs: DataFrame, signals: str) -> dict[str, Column]:
    return {n: F.col(signals)[n] for n in docs.schema[signals].dataType.fieldNames()}


def verdict(rules: list[Rule], text: Column, known: Mapping[str, Column] | None = None) -> Column:
    """Name of the first rule that rejects the text; null for a text that passes all.

    The words are split once for all rules, and not at all where signals are known.
    """
    def case(facts: Facts) -> Column:
        out = F  # each rule is one more branch of a single CASE
        for rule in rules:
            out = out.when(rule.rejects(facts), F.lit(rule.name))
        return F.lit(None).cast("string") if out is F else out

    return let(words(text), lambda w: case(Facts(text, w))) if known is None else case(Facts(text, words(text), known))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
            signals: str | None = None) -> DataFrame:
    """``docs`` with ``rejected_by``, null where the document is kept.

    ``signals``: a struct column of some of ``SIGNALS`` that is there already;
    rules read these and make only the others.
    """
    order = ordered(measure(docs, rules, text_col, sample_rows, signals))
    return docs.withColumn("rejected_by", verdict(order, F.col(text_col), _known(docs, signals) if signals else None))


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    inner = cascade(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text")), rules)
    return inner.where(F.col("rejected_by").isNull()).select("_row.*")
