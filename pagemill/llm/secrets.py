"""Secret scans with a ledger of blobs.

A blob is a text by its SHA-256; a path is any row that holds it. The ledger
is a folder of two tables: ``scanned`` has every (blob, rule, version) that
was looked at, ``findings`` what was found there. A run hashes all versions of
all paths, takes the blobs and rule versions that the ledger doesn't have,
scans one text of each such blob by those rules, adds both to the ledger, and
joins the findings of the present rule versions back to all paths.

Findings are written before the pairs that they answer, so a run that breaks
off is done again by the next one, and equal rows count once.

Places are code points, end exclusive. A null text is the empty blob. Rows
that repeat an id are paths of their own. Columns of the input that aren't
named by the caller aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.store import shared_dir, written


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` (as the JVM reads it) whose ``group`` has ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which findings at one place are listed. Shorter runs than asked for can't hold or shift a longer one
#: in the last two, so their patterns state the length.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, "(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)

_SCANNED = "blob string, kind string, version int"
_FINDINGS = "blob string, kind string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _ledger(spark: SparkSession, folder: str, name: str, kind: str) -> DataFrame:
    """A table of the ledger; an empty one before the first run."""
    spark.createDataFrame([], kind).write.mode("append").parquet(f"{folder}/{name}")
    return spark.read.schema(kind).parquet(f"{folder}/{name}")


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match: characters since the one before, its own, and those of the group."""
    lengths = lambda texts: F.transform(texts, lambda x: F.length(x))
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"),
                          lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("n"),
                          lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("inner"))
    return F.filter(zipped, lambda z: z["n"].isNotNull())  # without what follows the last match


def matches(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, version, start, end for ``blobs`` (blob, text, kinds: names of the rules to apply).

    A text without a match costs one search per rule. Matches become rows and
    their places running sums, so a text with very many of them stays linear.
    """
    text = F.col("text")
    found = [F.when(F.array_contains("kinds", r.kind) & text.rlike(r.pattern), F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
        _pieces(text, r).alias("pieces"))) for r in rules]
    rows = blobs.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f"))
    rows = rows.select("blob", "f.kind", "f.version", "f.least", F.posexplode("f.pieces").alias("i", "p")).distinct()
    upto = Window.partitionBy("blob", "kind", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("p.gap") + F.col("p.n")).over(upto)
    rows = rows.select("blob", "kind", "version", "least", "p.n", "p.inner", end.cast("long").alias("end"))
    return rows.where(F.col("inner") >= F.col("least")).select("blob", "kind", "version", (F.col("end") - F.col("n")).alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """id, blob and findings (array of start, rank, kind, end, sorted) for every row of ``versions``.

    ``rank`` is the rule's place in ``rules``. What was scanned before under
    the same rule versions is taken from the ledger.
    """
    spark = versions.sparkSession
    scanned, findings = _ledger(spark, ledger, "scanned", _SCANNED), _ledger(spark, ledger, "findings", _FINDINGS)
    texts = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("blob", blob_of(F.col("text")))
    paths = written(texts.select("id", "blob"), shared_dir(spark, "blob-paths"))
    present = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    blobs = paths.groupBy("blob").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id")).alias("holder"))
    pairs = blobs.select("blob", "holder.id", F.explode(present).alias("r")).select("blob", "id", "r.kind", "r.version")
    unseen = written(pairs.join(scanned.distinct(), ["blob", "kind", "version"], "left_anti"), shared_dir(spark, "blob-unseen"))
    todo = unseen.groupBy("blob", "id").agg(F.collect_set("kind").alias("kinds")).withColumnsRenamed({"blob": "b", "id": "i"})
    # one holder's text for each blob; a holder that repeats its id and text gives the same pieces again, which count once
    chosen = texts.join(todo.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("blob") == F.col("b")))
    matches(chosen.select("blob", "text", "kinds"), rules).distinct().write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob", "kind", "version").write.mode("append").parquet(f"{ledger}/scanned")

    rank = F.array_position(F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules)),
                            F.concat_ws(":", "kind", "version")).cast("int")
    now = (spark.read.schema(_FINDINGS).parquet(f"{ledger}/findings").distinct().withColumn("rank", rank).where("rank > 0")
           .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("findings")))
    none = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")
    return paths.join(now, "blob", "left").select("id", "blob", F.coalesce("findings", none).alias("findings"))
