"""Tables, page scans and cookies (A1, A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.common import let, strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_records(pages: DataFrame) -> DataFrame:
    """Stored pages in the shape of a response; a page without a status is not ok."""
    have = set(pages.columns)

    def column(name: str, kind: str, default: str | int | None) -> Column:
        return F.col(name) if name in have else F.lit(default).cast(kind).alias(name)

    return pages.select(
        "page_id", "url", column("method", "string", "GET"), column("encoding", "string", ""),
        column("html", "string", ""), column("status", "int", -1), column("metadata", "map<string,string>", None),
        column("cookies", "map<string,string>", None),
        column("headers", "map<string,string>", None), column("history", "array<string>", None))


def cookie_map(header: Column) -> Column:
    """name -> value of a cookie header; a repeated name keeps its last value (A5)."""
    pairs = F.filter(F.transform(F.split(header, ";"), lambda p: F.struct(
        strip(F.substring_index(p, "=", 1)).alias("key"),
        strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"),
        p.contains("=").alias("pair"))), lambda e: e["pair"])
    def last_values(known: Column) -> Column:
        names = F.array_distinct(F.transform(known, lambda e: e["key"]))
        return let(names, lambda ns: F.map_from_arrays(ns, F.transform(
            ns, lambda n: F.element_at(F.filter(known, lambda e: e["key"] == n), -1)["value"])))

    return let(pairs, last_values)
