from __future__ import annotations

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from pagemill.llm import quotes

KIND = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted(((r["conv"], r["pos"], r["own"], tuple(r["parent"]) if r["parent"] else None, tuple(r["root"]) if r["root"] else None,
                    r["depth"], r["n_quoted"], r["n_linked"]) for r in df.collect()), key=repr)


def run(spark, rows, **more):
    return got(quotes.reply_order(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], KIND), **more))


def test_nested_quotes(spark):
    rows = [(1, 0, "Hello  there\nall"), (1, 1, "On Monday A wrote:\n> hello there\n> All\n\nFine."),
            (1, 2, "> > Hello there all\n> Fine.\nGood"), (1, 3, "no quote"), (1, 4, "> > Hello there all\nlate")]
    assert run(spark, rows) == [
        (1, 0, "Hello  there\nall", None, (1, 0), 0, 0, 0),
        (1, 1, "\nFine.", (1, 0), (1, 0), 1, 1, 1),
        (1, 2, "Good", (1, 1), (1, 0), 2, 2, 2),
        (1, 3, "no quote", None, (1, 3), 0, 0, 0),
        (1, 4, "late", (1, 0), (1, 0), 1, 1, 1)]


def test_parts_other_conversations_and_no_cycles(spark):
    rows = [(1, 0, "one line\nanother line"), (1, 1, "> another line\nyes"), (2, 0, "> one line\n> another line\nfrom elsewhere"),
            (3, 0, "> mine\nyours"), (3, 1, "> yours\nmine"), (4, 0, "> > x\n> nobody said this")]
    out = {r[:2]: (r[3], r[4], r[5], r[7]) for r in run(spark, rows)}
    assert out[(1, 1)] == ((1, 0), (1, 0), 1, 1)  # a passage of one line is a line of the original
    assert out[(2, 0)] == ((1, 0), (1, 0), 1, 1)
    assert out[(3, 0)] == (None, (3, 0), 0, 0)  # its quote is only said later
    assert out[(3, 1)] == ((3, 0), (3, 0), 1, 1)
    assert out[(4, 0)] == (None, (4, 0), 0, 0)


def test_a_long_chain_and_a_quote_that_all_share(spark):
    rows = [(1, 0, "t0")] + [(1, i, f"> t{i - 1}\nt{i}") for i in range(1, 300)] + [(c, 1, "> t0\nsame") for c in range(2, 200)]
    out = {r[:2]: r for r in run(spark, rows)}
    assert out[(1, 299)][4:6] == ((1, 0), 299)
    assert all(out[(c, 1)][3] == (1, 0) for c in range(2, 200))


def test_odd_rows(spark):
    rows = [(None, 0, "a"), (1, None, "> a\nb"), (1, 2, None), (1, 3, ""), (1, 4, ">"), (1, 5, "x"), (1, 5, "x"), (1, 6, "> x\ny"), (1, 6, "> x\ny"),
            (2, 0, "> " * 500 + "deep\n" + "long " * 50_000)]
    out = run(spark, rows)
    assert len(out) == len(rows)
    assert [r for r in out if r[:2] == (1, 6)] == [(1, 6, "y", (1, 5), (1, 5), 1, 1, 1)] * 2
    assert [r[3:6] for r in out if r[0] is None] == [(None, None, 0)]
    assert run(spark, rows[:0]) == []


def test_kept_columns(spark):
    table = spark.createDataFrame([(1, 0, "r", "a")], KIND).withColumnRenamed("role", "own")
    assert quotes.reply_order(table.withColumnRenamed("own", "mid"), keep=("mid",)).first()["mid"] == "r"


def plain_parse(text):
    """(own text, quoted passages): lines told apart one by one."""
    blank = r"[ \t\r\n\x0b\x0c]+"
    rows = []
    for line in text.split("\n"):
        marks = re.match(r"(?:[ \t]*>)+[ \t]?", line)
        marks = marks.group() if marks else ""
        rows.append([marks.count(">"), line, re.sub(blank, " ", line[len(marks):]).strip(" ").lower()])
    for row, after in zip(rows, rows[1:]):
        if row[0] == 0 and after[0] > 0 and re.fullmatch(r"On .* wrote:[ \t\r]*", row[1]):
            row[0] = -1
    found = []
    for level, run in itertools.groupby(rows, key=lambda r: r[0]):
        norms = [r[2] for r in run if r[2]]
        if level > 0 and norms:
            whole = (level, " ".join(norms))
            if len(norms) == 1:
                found.append((*whole, 3, 1))
            else:
                found += [(*whole, 2, 1)] + [(level, n, 1, 0) for n in norms]
    own = "\n".join(r[1] for r in rows if r[0] == 0) if any(r[0] > 0 for r in rows) else text
    return own, [(level, hashlib.sha256(n.encode()).digest(), len(n) * weight, runs) for level, n, weight, runs in found]


def test_parsing_against_plain_python(spark):
    rnd = random.Random(4)
    line = lambda: "".join(rnd.choice(["", "", "> ", ">", " >", ">> "]) for _ in range(2)) + rnd.choice(
        ["", " ", "a", "A  b", "日本 é", "On x wrote:", "On y wrote: \t", "tail\r", "c > d"])
    texts = ["\n".join(line() for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    texts += ["", "\n", ">", "> ", "\n".join(f"{'>' * (i % 3)} line {i}" for i in range(20_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", quotes.parsed(F.col("text")).alias("p"))
    for r in rows.collect():
        got = (r["p"]["own"], [(x["level"], bytes(x["hash"]), x["chars"], x["runs"]) for x in r["p"]["passages"]])
        assert got == plain_parse(texts[r["i"]]), texts[r["i"]][:200]


def test_clashing_columns(spark):
    names = ("hash", "level", "mid", "passages", "kept", "text2")
    table = spark.createDataFrame([(1, 0, "a", *names), (1, 1, "> a\nb", *names)], "conv_id long, turn long, text string, " + ", ".join(
        f"{n} string" for n in names))
    rows = sorted(quotes.reply_order(table, keep=names).collect(), key=lambda r: r["pos"])
    assert [tuple(r[n] for n in names) for r in rows] == [names] * 2 and rows[1]["parent"]["pos"] == 0
