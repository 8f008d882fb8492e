"""Small Column helpers shared by the function modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A plain column would be inlined into lambda bodies and evaluated again for
    every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


_CHUNK = 64


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element, ``step`` folded over the array up to and with it.

    Appending to an array copies it, so the result grows in chunks, each of
    which begins with the last value of the one before.
    """
    def append(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(step(F.element_at(done, -1), x)))

    def fold(v: Column) -> Column:
        count = F.ceil(F.size(v) / _CHUNK).cast("int")
        return F.aggregate(F.array_repeat(F.lit(0), count), F.array(F.array(zero)), lambda parts, _: F.concat(parts, F.array(F.aggregate(
            F.slice(v, (F.size(parts) - 1) * _CHUNK + 1, F.lit(_CHUNK)), F.array(F.element_at(F.element_at(parts, -1), -1)), append))),
            lambda parts: F.flatten(F.transform(parts, lambda p: F.slice(p, F.lit(2), F.lit(_CHUNK)))))

    return let(values, fold)


# The characters that count as whitespace.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Unicode-aware trim of both ends (``trim`` removes spaces only); looks at the ends, not the whole text."""
    return F.btrim(col, F.lit(WHITESPACE))


def squeeze_ws(col: Column) -> Column:
    """Remove every whitespace character, Unicode ones included."""
    return F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", "")


def not_empty(col: Column) -> Column:
    """NULL for the empty string; the argument is evaluated once, also inside lambdas."""
    return let(col, lambda t: F.when(t != "", t))


_COUNT = re.compile(r"\{(\d*)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([aiLmsux]*)(-[imsx]+)?([:)])")


def pattern_parts(compiled: re.Pattern) -> list[tuple[str, int]]:
    """The pattern in the JVM's notation, in pieces, each with the place where it starts in the Python one.

    Raises ValueError where the JVM has no such form.
    """
    text, out, at, in_class, first = compiled.pattern, [], 0, False, False
    verbose = bool(compiled.flags & re.X)

    def refuse(what: str) -> None:
        raise ValueError(f"{what} in {text!r} can't be said to the JVM")

    while at < len(text):
        here, c = at, text[at]
        if c == "\\":
            n = text[at + 1]
            at += 2
            if n == "Z":
                piece = r"\z"
            elif n == "v":
                piece = r"\x0B"
            elif n == "b" and in_class:
                piece = r"\x08"
            elif n == "0" or (n.isdigit() and (in_class or re.match(r"[0-3][0-7]{2}", text[at - 1:]))):
                digits = re.match(r"[0-7]{1,3}", text[at - 1:])
                piece, at = rf"\x{{{int(digits[0], 8):x}}}", at - 1 + digits.end()
            elif n == "U":
                piece, at = rf"\x{{{text[at:at + 8]}}}", at + 8
            elif n == "N":
                refuse("a named character")
            else:
                piece = text[here:at]
            first = False
        elif in_class:
            at += 1
            if c == "]" and not first:
                piece, in_class = c, False
            elif c in "[]" or (c == "&" and text[at - 2:at - 1] == "&") or (verbose and (c.isspace() or c == "#")):
                piece = "\\" + c
            else:
                piece = c
            first = first and c == "^" and out[-1][0] == "["
        elif c == "[":
            piece, in_class, first, at = c, True, True, at + 1
        elif c == "{":
            count = _COUNT.match(text, at)
            if count is None or not (count[1] or count[2]):
                piece, at = r"\{", at + 1
            else:
                piece, at = f"{{{count[1] or 0}{count[2]}{count[3]}}}", count.end()
        elif text.startswith("(?#", at):
            at = text.index(")", at) + 1
            piece = ""
        elif text.startswith("(?P<", at):
            piece, at = "(", text.index(">", at) + 1  # groups are read by number, the JVM's names are narrower
        elif text.startswith("(?P=", at):
            end = text.index(")", at)
            piece, at = rf"(?:\{compiled.groupindex[text[at + 4:end]]})", end + 1
        elif text.startswith("(?(", at):
            refuse("a condition on a group")
        elif flags := _FLAGS.match(text, at):
            on = "".join(f for f in flags[1] if f in "imsx")
            piece, at = f"(?{on}{flags[2] or ''}{flags[3]}", flags.end()
            piece = "" if piece == "(?)" else piece
        elif verbose and c == "#":
            at = (text + "\n").index("\n", at) + 1
            piece = ""
        else:
            piece, at = c, at + 1
        out.append((piece, here))
    return out


def java_pattern(pattern: str | re.Pattern) -> str:
    """A Python pattern with its flags, in the JVM's notation."""
    if isinstance(pattern, str):
        pattern = re.compile(pattern)
    flags = "".join(f for f, bit in (("i", re.I), ("s", re.S), ("m", re.M), ("x", re.X)) if pattern.flags & bit)
    # d: only \n ends a line; U: \w, \s and \d are Unicode-aware
    return f"(?{flags}d{'' if pattern.flags & re.ASCII else 'U'})" + "".join(p for p, _ in pattern_parts(pattern))


def group_source(compiled: re.Pattern, number: int) -> str:
    """What stands between the brackets of a group."""
    text, opened, count = compiled.pattern, [], 0
    for piece, at in pattern_parts(compiled):
        if piece == "(" and (text.startswith("(?P<", at) or not text.startswith("(?", at)):
            count += 1
            begin = text.index(">", at) + 1 if text.startswith("(?P<", at) else at + 1
            opened.append((count, begin))
        elif piece.startswith("(") and not piece.endswith(")"):
            opened.append((0, at))
        elif piece == ")":
            group, begin = opened.pop()
            if group == number:
                return text[begin:at]
    raise IndexError(number)


# A table is broadcast when its rows, written out as JSON, stay within this.
MAX_BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast after measuring it; a larger one is joined by a shuffle.

    The measuring pass reads this table only, which is worth it where the
    other side would otherwise be shuffled with its page texts.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
