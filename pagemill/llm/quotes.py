"""Conversations in reply order, from messages that quote each other.

A line that starts with n marks ">" is quoted at level n; a passage is a run
of lines of one level. Passages are normalised (marks off, white space as one
blank, lower case) and hashed; so are the own words of every message, whole
and line by line. A passage's original is the first message that has it: in
the same conversation if it comes before the quoting message, else the first
of all messages, if that comes before by (conversation, position). A message
replies to the original with most quoted characters at its lowest quoted level
that has an original (a whole passage counts twice, so lines decide only
between originals of parts), and threads hang on messages that reply to none.

Originals are one row per hash before anything is joined to them, so a passage
that a third of all messages quote, and a conversation of any length, meet one
row. Threads are followed by doubling: a chain of n replies takes log n joins.

A message is parsed inside its row, by array expressions whose work is linear
in its lines, and stored once: its own words, and of what it quotes the hashes
only. Nothing but those hashes and places is joined; the own words come back
by one join at the end.

A null text is empty, and an empty table gives an empty result. Null
conversations or positions are values of their own, first in order, and never
equal to others: such a message can't be an original. Repeated rows stay apart
and get the same answer; of originals that tie in all of level, characters and
position the one of the largest conversation is taken. A text may be as long as
a row can be. Only the named columns are read; ``keep`` may name columns called
like any that are made here, but for those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.common import let
from pagemill.llm.store import shared_dir, written

_BLANK = r"[ \t\r\n\x0b\x0c]{2,}|[\t\r\n\x0b\x0c]"  # what isn't one blank yet
_MARKS = r"^(?:[ \t]*>)+[ \t]?"
_QUOTES = r"(?m)^[ \t]*>"
_WROTE = r"^On .* wrote:[ \t\r]*$"
_PASSAGES = "array<struct<level:int,hash:binary,chars:bigint,runs:bigint>>"


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, _BLANK, " ")))


def passage_hash(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _lines(text: Column) -> Column:
    """line, level and, if quoted, text without marks of every line; level -1: the line that says who wrote what follows."""
    def read(line: Column) -> Column:
        quoted = let(F.regexp_extract(line, _MARKS, 0), lambda marks: F.struct(
            line.alias("line"), (F.length(marks) - F.length(F.replace(marks, F.lit(">")))).alias("level"),
            normalised(F.substring(line, F.length(marks) + 1, F.length(line))).alias("norm")))
        return F.when(F.ltrim(line, F.lit(" \t")).startswith(">"), quoted).otherwise(
            F.struct(line.alias("line"), F.lit(0).alias("level"), F.lit("").alias("norm")))

    def told(lines: Column) -> Column:
        def level(x: Column, i: Column) -> Column:
            wrote = (x["level"] == 0) & x["line"].rlike(_WROTE) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
            return F.struct(x["line"].alias("line"), F.when(wrote, -1).otherwise(x["level"]).alias("level"), x["norm"].alias("norm"))
        return F.transform(lines, level)

    return let(F.transform(F.split(text, "\n", -1), read), told)


def _passages(lines: Column) -> Column:
    """level, hash, weighted characters and number of whole passages (0 or 1) of each passage and of each of its lines.

    A whole passage counts twice, its lines once; the only line of a passage is both.
    """
    def entry(level: Column, norm: Column, weight: int, runs: int) -> Column:
        return F.struct(level.cast("int").alias("level"), passage_hash(norm).alias("hash"),
                        (F.length(norm) * weight).cast("bigint").alias("chars"), F.lit(runs).cast("bigint").alias("runs"))

    def of_run(level: Column, norms: Column) -> Column:
        return F.when(F.size(norms) == 0, F.array().cast(_PASSAGES)).when(
            F.size(norms) == 1, F.array(entry(level, norms[0], 3, 1))).otherwise(
            F.concat(F.array(entry(level, F.array_join(norms, " "), 2, 1)), F.transform(norms, lambda x: entry(level, x, 1, 0))))

    def runs(begins: Column) -> Column:
        def one(begin: Column, k: Column) -> Column:
            end = F.coalesce(F.get(begins, k + 1), F.size(lines))
            norms = F.transform(F.filter(F.slice(lines, begin + 1, end - begin), lambda x: x["norm"] != ""), lambda x: x["norm"])
            level = F.get(lines, begin)["level"]
            return F.when(level > 0, let(norms, lambda n: of_run(level, n))).otherwise(F.array().cast(_PASSAGES))
        return F.flatten(F.transform(begins, one))

    changes = F.transform(lines, lambda x, i: F.when((i == 0) | (x["level"] != F.get(lines, i - 1)["level"]), i))
    return let(F.filter(changes, lambda i: i.isNotNull()), runs)


def parsed(text: Column) -> Column:
    """Struct of own, the text without quotes, and passages, what it quotes."""
    def read(lines: Column) -> Column:
        own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"])
        return F.struct(F.array_join(own, "\n").alias("own"), _passages(lines).cast(_PASSAGES).alias("passages"))

    plain = F.struct(text.alias("own"), F.array().cast(_PASSAGES).alias("passages"))
    return F.when(text.rlike(_QUOTES), let(_lines(text), read)).otherwise(plain)


def originals(messages: DataFrame) -> DataFrame:
    """hash, conv, pos: each message under the hashes of its own words, whole and by line. ``messages``: conv, pos, own."""
    norms = F.array_distinct(F.concat(F.array(normalised(F.col("own"))),
                                      F.transform(F.split("own", "\n", -1), lambda x: normalised(x))))
    rows = messages.where("conv is not null and pos is not null").select("conv", "pos", F.explode(norms).alias("norm"))
    return rows.where("norm <> ''").select(passage_hash(F.col("norm")).alias("hash"), "conv", "pos")


def linked(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """mid, parent (conv, pos) and the number of whole passages that have an original.

    ``passages``: mid, conv, pos, level, hash, chars, runs.
    """
    here = sources.groupBy("hash", "conv").agg(F.min("pos").alias("first"))
    first = here.groupBy("hash").agg(F.min(F.struct(F.col("conv").alias("conv"), F.col("first").alias("pos"))).alias("any"))
    rows = passages.join(first.withColumnRenamed("hash", "h2"), F.col("hash") == F.col("h2")).drop("h2")
    rows = rows.join(here.withColumnsRenamed({"hash": "h1", "conv": "c1"}), (F.col("hash") == F.col("h1")) & (F.col("conv") == F.col("c1")), "left")
    own = F.struct(F.col("conv").alias("conv"), F.col("pos").alias("pos"))
    to = F.when(F.col("first") < F.col("pos"), F.struct(F.col("conv").alias("conv"), F.col("first").alias("pos"))).when(
        F.col("any") < own, F.col("any"))
    votes = (rows.select("mid", "level", "runs", to.alias("to"), "chars").where("to is not null")
             .groupBy("mid", "level", "to").agg(F.sum("chars").alias("chars"), F.sum("runs").alias("runs")))
    best = F.struct(-F.col("level"), F.col("chars"), -F.col("to.pos"), F.col("to.conv"))
    return votes.groupBy("mid").agg(F.max_by("to", best).alias("parent"), F.sum("runs").alias("n_linked"))


def threads(replies: DataFrame, folder: str) -> DataFrame:
    """conv, pos, root (conv, pos), depth of every message. ``replies``: conv, pos, parent, always an earlier message."""
    me = F.struct(F.col("conv").alias("conv"), F.col("pos").alias("pos"))
    first = written(replies.groupBy("conv", "pos").agg(F.min("parent").alias("parent")).select(
        "conv", "pos", F.coalesce("parent", me).alias("root"), F.col("parent").isNotNull().cast("long").alias("depth")), f"{folder}/threads-0")
    settled, moving, step = first.where("depth = 0"), first.where("depth > 0"), 0
    while not moving.isEmpty():
        step += 1
        up = settled.unionByName(moving).where("depth > 0").select(
            F.struct("conv", "pos").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more"))
        now = written(moving.join(up, F.col("root") == F.col("at"), "left").select(
            "conv", "pos", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved")), f"{folder}/threads-{step}")
        # a message whose root replies to none is done, so each round has only the longer threads
        settled, moving = settled.unionByName(now.where("not moved").drop("moved")), now.where("moved").drop("moved")
    return settled


def reply_order(messages: DataFrame, conv_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """conv, pos, own text, parent, root, depth, n_quoted, n_linked and the columns ``keep`` of every row.

    Rows in order of (root, pos) are the conversations in reply order: a
    message comes after the one that it replies to.
    """
    folder = shared_dir(messages.sparkSession, "quotes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = messages.select(F.monotonically_increasing_id().alias("mid"), F.col(conv_col).cast("long").alias("conv"),
                           F.col(pos_col).cast("long").alias("pos"), parsed(text).alias("parsed"),
                           (F.struct(*keep) if keep else F.lit(None).cast("int")).alias("kept"))
    rows = written(rows.select("mid", "conv", "pos", "parsed.own", "parsed.passages", "kept"), f"{folder}/messages")
    passages = rows.select("mid", "conv", "pos", F.explode("passages").alias("p")).select("mid", "conv", "pos", "p.*")
    parents = linked(passages, originals(rows.select("conv", "pos", "own")))
    zero = F.lit(0).cast("long")
    n_quoted = F.aggregate("passages", zero, lambda n, p: n + p["runs"]).alias("n_quoted")
    replies = written(rows.select("mid", "conv", "pos", n_quoted).join(parents, "mid", "left"), f"{folder}/replies")
    tree = threads(replies.where("conv is not null and pos is not null"), folder).withColumnsRenamed({"conv": "c", "pos": "p"})
    places = replies.join(tree, (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("p")), "left")
    out = rows.select("mid", "own", "kept").join(places, "mid")
    return out.select("conv", "pos", "own", "parent", "root", F.coalesce("depth", zero).alias("depth"), "n_quoted",
                      F.coalesce("n_linked", zero).alias("n_linked"), *(["kept.*"] if keep else []))
