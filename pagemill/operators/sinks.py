"""Keyed, idempotent writes.

A NULL key is a key like others.  Of rows with one key the one with the least
or greatest order counts, rows without an order after all others that have
one; equal orders are decided by the rows' values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of a vocabulary record and its initial status.
VOCABULARY = ["name_chinese", "name_english", "phonetic", "status", "voice"]
NEW_STATUS = "undo"


def _one_per_key(rows: DataFrame, key: str, order: str, last: bool) -> DataFrame:
    """First or last row per key as an aggregate, combined before the shuffle; a hot key costs one row per task."""
    values = F.struct(*(c for c in rows.columns if c != key))
    rank = F.struct(F.col(order).isNotNull() if last else F.col(order).isNull(), F.col(order), values)
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key).agg(pick(values, rank).alias("_row")).select(key, "_row.*")


def _keys(stored: DataFrame, key: str) -> DataFrame:
    return stored.select(F.col(key).alias("_key"))


def existing_keys(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is stored (H4)."""
    return incoming.join(_keys(stored, key), F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def missing_keys(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return incoming.join(_keys(stored, key), F.col(key).eqNullSafe(F.col("_key")), "left_anti")


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to add: the first of each key not yet stored (B1).

    Running it again with those rows stored adds nothing.
    """
    return missing_keys(_one_per_key(incoming, key, order, last=False), stored, key)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The table after writing the last row of each key over the stored fields (B2): what ``KeyedStore.upsert`` stores.

    Fields absent from ``incoming`` keep their value; a given NULL overwrites.
    ``inserted`` marks the keys that were not there before.
    """
    last = _one_per_key(incoming, key, order, last=True).withColumn("_given", F.lit(True)).withColumnRenamed(key, "_key")
    fields = [c for c in incoming.columns if c not in (key, order)]
    both = stored.withColumn("_stored", F.lit(True)).alias("s").join(
        last.alias("u"), F.col(f"s.{key}").eqNullSafe(F.col("u._key")), "full_outer")

    def merged(name: str) -> Column:
        if name not in fields:
            return F.col(f"s.{name}")
        if name not in stored.columns:
            return F.col(f"u.{name}")
        return F.when(F.col("_given"), F.col(f"u.{name}")).otherwise(F.col(f"s.{name}")).alias(name)

    names = [c for c in stored.columns if c != key] + [c for c in fields if c not in stored.columns]
    keys = F.when(F.col("_stored"), F.col(f"s.{key}")).otherwise(F.col("u._key")).alias(key)
    return both.select(keys, *(merged(n) for n in names), F.col("_stored").isNull().alias("inserted"))


class KeyedStore:
    """A stored table with one row per key, in versions of its buckets.

    Keys are dealt to a fixed number of buckets by hash.  A write first stores
    what comes in, so that it is computed once, reads the buckets of its keys
    only and writes ``data/bucket=B/version=V``: an insert the new rows alone, an
    upsert the whole bucket.  Then it adds a row per bucket to
    ``switches/version=V``, which is one file moved into place as a whole.
    Readers take, of each bucket, the last whole version that was switched to and
    the ones after it, so a write that breaks off leaves the table as it was,
    and its folders are not read by anyone.  A bucket of many versions becomes
    whole again with its next write.  One writer at a time; the same write
    again changes nothing but the version.

    ``buckets`` and ``files`` (tasks that write a bucket) are for the caller to
    choose from the size of the data; a file has ``rows_per_file`` rows at most.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64, files: int = 8,
                 rows_per_file: int = 4_000_000, most_versions: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.files, self.rows_per_file, self.most_versions = files, rows_per_file, most_versions
        self.full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _current(self) -> dict[int, list[int]]:
        """The versions of each bucket that are to be read; a row per bucket and write reaches the driver, no more than those kept."""
        kind = "bucket int, version long, whole boolean"
        try:
            switches = self.spark.read.schema(kind).parquet(f"{self.path}/switches")
        except AnalysisException:  # nothing is stored yet
            return {}
        whole = F.coalesce("whole", F.lit(True))
        last = switches.where(whole).groupBy("bucket").agg(F.max("version").alias("base"))
        kept = switches.join(last, "bucket", "left").where(F.col("base").isNull() | (F.col("version") >= F.col("base")))
        found: dict[int, list[int]] = {}
        for r in kept.select("bucket", "version").distinct().collect():
            found.setdefault(r.bucket, []).append(r.version)
        return found

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The stored rows, of all buckets or of some; only the folders of their versions are read."""
        parts = {b: v for b, v in self._current().items() if buckets is None or b in buckets}
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        chosen = F.lit(False)
        for bucket, versions in parts.items():
            chosen = chosen | ((F.col("bucket") == bucket) & F.col("version").isin(versions))
        return self.spark.read.schema(self.full).parquet(f"{self.path}/data").where(chosen).select(*self.schema.names)

    def _write(self, new_rows: Callable[[DataFrame, DataFrame], DataFrame] | None,
               changed: Callable[[DataFrame, DataFrame], DataFrame], incoming: DataFrame) -> list[int]:
        """``new_rows`` gives what to add to buckets of few versions, ``changed`` the whole buckets otherwise."""
        current = self._current()
        version = 1 + max((v for versions in current.values() for v in versions), default=-1)
        given = f"{self.path}/incoming/version={version}"
        incoming.write.mode("overwrite").parquet(given)
        incoming = self.spark.read.schema(incoming.schema).parquet(given)
        touched = sorted(r.bucket for r in incoming.select(self._bucket().alias("bucket")).distinct().collect())
        if not touched:
            return []
        whole = {b for b in touched if new_rows is None or len(current.get(b, [])) >= self.most_versions}
        for add, some in ((True, [b for b in touched if b not in whole]), (False, sorted(whole))):
            if not some:
                continue
            stored, rows = self.rows(some), incoming.where(self._bucket().isin(some))
            made = (new_rows if add else changed)(stored, rows).select(*self.schema.names)
            (made.withColumn("bucket", self._bucket()).withColumn("version", F.lit(version).cast("long"))
             .repartition("bucket", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(self.files))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic")  # of this version, should an earlier attempt have left some
             .option("maxRecordsPerFile", self.rows_per_file).partitionBy("bucket", "version").parquet(f"{self.path}/data"))
        (self.spark.createDataFrame([(b, b in whole) for b in touched], "bucket int, whole boolean").coalesce(1).write.mode("overwrite")
         .parquet(f"{self.path}/switches/version={version}"))
        return touched

    def insert(self, incoming: DataFrame, order: str) -> list[int]:
        """Add the first row of each key that isn't stored (B1); the buckets that were looked at."""
        def new(stored: DataFrame, rows: DataFrame) -> DataFrame:
            none = self.spark.createDataFrame([], self.schema)
            added = none.unionByName(insert_if_absent(stored, rows, self.key, order), allowMissingColumns=True)
            return added.select(*self.schema.names)
        return self._write(new, lambda stored, rows: stored.unionByName(new(stored, rows)), incoming)

    def upsert(self, incoming: DataFrame, order: str) -> list[int]:
        """Write the last row of each key over the stored fields (B2); the buckets that were rewritten."""
        return self._write(None, lambda stored, rows: upsert(stored, rows, self.key, order), incoming)


def vocabulary_documents(words: DataFrame) -> DataFrame:
    """Vocabulary records keyed by the English name; a record starts out undone."""
    have = set(words.columns)
    status = F.coalesce(F.col("status"), F.lit(NEW_STATUS)) if "status" in have else F.lit(NEW_STATUS)
    rows = words.withColumn("status", status)
    return rows.select(F.col("name_english").alias("_id"), *VOCABULARY)


def dump(documents: DataFrame) -> DataFrame:
    """Documents as JSON text by key, absent values written as null."""
    body = F.to_json(F.struct(*sorted(documents.columns)), {"ignoreNullFields": "false"})
    return documents.select("_id", body.alias("document"))


Sink = Callable[[DataFrame], None]


def write_outputs(outputs: dict[str, DataFrame], sinks: dict[str, Sink]) -> None:
    """Hand each kind of output to its sink; an output kind without one is an error (M3u)."""
    unknown = sorted(set(outputs) - set(sinks))
    if unknown:
        raise ValueError(f"no sink for {', '.join(unknown)}")
    for kind, rows in outputs.items():
        sinks[kind](rows)
