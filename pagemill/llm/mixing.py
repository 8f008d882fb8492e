"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / weight, with u from a hash
of its id and the weight from the quality of its text. A source that is to
give ``target`` words gives complete epochs first, then the documents with the
smallest keys until the rest of its budget is filled: the prefix sum over the
documents in order of their keys is cut where the middle of a document passes
the budget, so a source misses its target by half a document at most.

The prefix sum isn't taken in one task: keys are cut into ranges per source,
as many as its number of documents asks for; range totals are summed first,
and only the range where the budget ends is sorted. What is kept for the rows
is one cut per source.

Nulls: a null text has no words; a null source is a source of its own, after
all others; a null id draws the key of the text "null". Rows with equal ids
and weights draw equal keys and are taken or left together. A source without
words has the target 0. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.store import shared_dir, written

WEIGHTS = (5, 2, 1)
#: Shares of all words that the mix has, and of its own words that a source gives at most; in halves.
TOTAL_HALVES, CAP_HALVES = 3, 4
#: Documents meant for one range of keys.
RANGE_ROWS = 4096
_SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, down to 0.1 with a sign of markup or code at every fourth word."""
    plain = text
    for sign in _SYMBOLS:
        plain = F.replace(plain, F.lit(sign))
    signs = F.length(text) - F.length(plain)
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 4.0 * signs / F.greatest(size, F.lit(1))), F.lit(0.1))


def exponential_key(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an MD5."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, docs → with target. One row per source.

    Sources in code point order weigh 5, 2, 1, 5, …; each gets its share of
    1.5 times all words but stops at twice its own, and what is over is shared
    again among the others. With the sources in order of cap / weight those
    that stop come first, so one pass finds where stopping ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), number + 1).cast("long")
    named = sizes.withColumn("weight", weight)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    # all in halves of a word: exact in 64 bits
    ranked = named.select(
        "*", (F.sum("source_size").over(whole) * TOTAL_HALVES).alias("_all"), F.sum("weight").over(whole).alias("_weights"),
        F.coalesce(F.sum("source_size").over(before) * CAP_HALVES, F.lit(0)).alias("_stopped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_gone"))
    rest = ranked.select("*", (F.col("_all") - F.col("_stopped")).alias("_num"),
                         (F.col("_weights") - F.col("_gone")).alias("_den"))
    stops = F.col("source_size").cast("decimal(38,0)") * CAP_HALVES * F.col("_den") <= F.col("_num").cast(
        "decimal(38,0)") * F.col("weight")
    # the first source that doesn't stop sets the level for all after it
    first = F.first(F.when(~stops, F.struct("_num", "_den")), ignorenulls=True).over(whole)
    level = rest.withColumn("_level", first).withColumn("_stops", stops)
    share = (F.col("weight") * F.col("_level._num")).cast("double") / (F.col("_level._den") * 2).cast("double")
    return level.select("source", "source_size", "docs", F.when(
        F.col("_stops"), (F.col("source_size") * CAP_HALVES / 2).cast("double")).otherwise(share).alias("target"))


def _range(key: Column, mean_weight: Column, ranges: Column) -> Column:
    """Number of the key's range: ascending in the key, about as many documents in each."""
    return F.floor(ranges * (1.0 - F.exp(-key * mean_weight))).cast("long")


def cuts(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per source: target, complete epochs, and where its fractional epoch ends.

    ``rows``: source, doc_id, size, key, weight.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"),
                                         F.avg("weight").alias("mean_weight"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (targets(sources.select("source", "source_size", "docs")).withColumnRenamed("source", "s")
            .join(sources.select("source", "mean_weight"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
            .withColumn("epochs", epochs.cast("long"))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
            .withColumn("ranges", F.ceil(F.col("docs") / range_rows)))
    plan = written(plan, shared_dir(rows.sparkSession, "mix-plan"))
    ranged = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "doc_id", "size", "key", "rest", _range(F.col("key"), F.col("mean_weight"), F.col("ranges")).alias("range"))
    by_source = Window.partitionBy("source").orderBy("range")
    sums = ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("n"))
    sums = sums.select("*", F.coalesce(F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, -1)),
                                       F.lit(0)).alias("before"))
    last = (sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") > 0)).groupBy("source")
            .agg(F.max_by(F.struct("range", "before"), "range").alias("last")).select("source", "last.*"))
    last = last.withColumnsRenamed({"source": "s", "range": "r"})
    near = ranged.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    # equal (key, id) rows share their place: the sum runs over whole ties
    ties = near.groupBy("source", "range", "before", "rest", "key", "doc_id").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last())
    upto = F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = ties.withColumn("upto", upto).where(2 * F.col("upto") - F.col("n") <= 2 * F.col("rest"))
    end = inside.groupBy("source").agg(F.max(F.struct(
        F.col("key"), F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("end"))
    end, last = end.withColumnRenamed("source", "e"), last.select(F.col("s"), F.col("r").alias("last_range"))
    whole = (plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
             .join(end, F.col("source").eqNullSafe(F.col("e")), "left").drop("s", "e"))
    # stored, so that Spark knows its size: sent to the rows if it is small, else the rows are shuffled and hot sources split
    return written(whole, shared_dir(rows.sparkSession, "mix-cuts"))


def copies(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, key, …) with target, source_size and copies: how often the mix takes the row."""
    held = plan.withColumnRenamed("source", "_s")
    here = _range(F.col("key"), F.col("mean_weight"), F.col("ranges"))
    place = F.struct(F.col("key"), F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    chosen = F.coalesce((here < F.col("last_range")) | ((here == F.col("last_range")) & (place <= F.col("end"))), F.lit(False))
    return (rows.join(held, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("copies", F.col("epochs") + chosen.cast("long"))
            .drop("_s", "docs", "mean_weight", "epochs", "rest", "ranges", "last_range", "end"))


def keyed(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """source, doc_id, size, weight and key of every row."""
    text = F.col(text_col)
    sized = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("doc_id"),
                        word_count(text).alias("size"), text.alias("_text"))
    weighed = sized.withColumn("weight", quality_weight(F.col("_text"), F.col("size"))).drop("_text")
    return weighed.withColumn("key", exponential_key(F.col("doc_id"), F.col("weight"), seed))


def mix(docs: DataFrame, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken (copies times size) of every row of ``docs``."""
    rows = written(keyed(docs, seed), shared_dir(docs.sparkSession, "mix-keys"))
    return copies(cuts(rows, range_rows), rows).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of ``docs``, as often as the mix takes them, with their own columns."""
    plan = cuts(written(keyed(docs, seed), shared_dir(docs.sparkSession, "mix-keys")), range_rows)
    text = F.col("_row.text")
    rows = docs.select(F.struct("*").alias("_row")).select(
        "_row", F.col("_row.source").cast("string").alias("source"), F.col("_row.doc_id").alias("doc_id"),
        word_count(text).alias("_size"))
    rows = rows.withColumn("key", exponential_key(F.col("doc_id"), quality_weight(text, F.col("_size")), seed))
    taken = copies(plan, rows).where(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
