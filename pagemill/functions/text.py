"""Text predicates and regex extraction as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.common import group_source, java_pattern, not_empty

# Headline markers, title separators (tried in this order), character classes.
HEADLINE_MARKERS = ["【详情】", "【详细】", "更多"]
TITLE_SEPARATORS = [" - ", "–", "—", "-", "|", "::"]
CHAR_CLASSES = {"chinese": r"[一-龥]", "digit": r"(?U)\d", "letter": r"[a-zA-Z]"}
# Fixed value: dates of this century as written in headlines.
DATE_PATTERN = r"20[0-9]{2}[-年/][01]?[0-9][-月/][0123]?[0-9]日?"


def is_headline(col: Column) -> Column:
    """Text on one line without a marker."""
    inner = F.regexp_replace(col, r"\n$", "")
    clean = ~inner.contains("\n")
    for marker in HEADLINE_MARKERS:
        clean = clean & ~col.contains(marker)
    return clean


def date_text(col: Column) -> Column:
    """First date written in the text, NULL when there is none (C4)."""
    return not_empty(F.regexp_extract(col, DATE_PATTERN, 0))


def date_value(col: Column) -> Column:
    """The first written date as a DATE, NULL when it is not a real day."""
    digits = F.regexp_extract_all(date_text(col), F.lit(r"\d+"), F.lit(0))
    return F.try_to_date(F.array_join(digits, "-"), "y-M-d")


def char_counts(col: Column) -> dict[str, Column]:
    """Characters per class."""
    return {name: F.regexp_count(col, F.lit(pattern)) for name, pattern in CHAR_CLASSES.items()}


def clean_title(col: Column) -> Column:
    """Text before the first separator that occurs, in the listed order."""
    result = None
    for sep in TITLE_SEPARATORS:
        cut = F.substring_index(col, sep, 1)
        result = F.when(col.contains(sep), cut) if result is None else result.when(col.contains(sep), cut)
    return result.otherwise(col)


def _group(compiled: re.Pattern, i: int, value: Column) -> Column:
    """NULL for a group that took no part in the match.

    Spark reports such a group as ''.  Where the group cannot match the empty
    string the two are told apart by the pattern itself.
    """
    return not_empty(value) if i and not _may_be_empty(compiled, i) else value


_CONTEXT = re.compile(r"\(\?<?[=!]|\(\?P=|\\[1-9bB]")


def _may_be_empty(compiled: re.Pattern, i: int) -> bool:
    """Whether a group can match the empty string; one that looks around itself may."""
    source = group_source(compiled, i)
    return bool(_CONTEXT.search(source)) or re.compile(source, compiled.flags).fullmatch("") is not None


def regex_single(col: Column, pattern: str | re.Pattern, default: str | None = None) -> Column:
    """First match: struct of named groups, the only group, array of groups, or the whole match.

    NULL (or ``default``, for the string forms) when nothing matches.
    """
    compiled = re.compile(pattern) if isinstance(pattern, str) else pattern
    java = java_pattern(compiled)

    def group(i: int) -> Column:
        return _group(compiled, i, F.regexp_extract(col, java, i))

    if compiled.groupindex:
        value = F.struct(*(group(i).alias(n) for n, i in compiled.groupindex.items()))
    elif compiled.groups > 1:
        value = F.array(*(group(i) for i in range(1, compiled.groups + 1)))
    else:
        found = F.when(col.rlike(java), group(compiled.groups))
        return F.coalesce(found, F.lit(default)) if default else found
    return F.when(col.rlike(java), value)


def regex_error(col: Column, pattern: str | re.Pattern, default: str | None = None) -> Column:
    """Message where a single match is required and there is none; a non-empty default covers it."""
    missing = F.lit(False) if default else ~col.rlike(java_pattern(pattern))
    return F.when(missing, F.lit("nothing matched for regex"))


def regex_many(col: Column, pattern: str | re.Pattern) -> Column:
    """All non-overlapping matches, an empty array when there is none."""
    compiled = re.compile(pattern) if isinstance(pattern, str) else pattern
    java = java_pattern(compiled)

    def group(i: int) -> Column:
        return F.transform(F.regexp_extract_all(col, F.lit(java), F.lit(i)), lambda v: _group(compiled, i, v))

    if compiled.groups <= 1:
        return group(compiled.groups)
    names = {i: n for n, i in compiled.groupindex.items()}
    columns = [group(i) for i in range(1, compiled.groups + 1)]
    zipped = F.arrays_zip(*(c.alias(f"g{i}") for i, c in enumerate(columns)))
    if names:
        return F.transform(zipped, lambda z: F.struct(*(z[f"g{i - 1}"].alias(n) for i, n in sorted(names.items()))))
    return F.transform(zipped, lambda z: F.array(*(z[f"g{i}"] for i in range(len(columns)))))
