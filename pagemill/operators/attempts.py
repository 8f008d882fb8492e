"""Fetch attempts and their outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Retries after the first attempt, status of a request that never succeeded.
RETRIES = 3
FAILED_STATUS = -1
# Cookie names and name prefixes that are passed on.
COOKIE_NAMES = ["TSPD_101", "TS01d02f4c", "WASSESSION"]
COOKIE_PREFIXES = ["Hm_lvt_", "Hm_lpvt_"]


def is_ok(status: Column) -> Column:
    """0 or 200..299; no status is not ok."""
    return F.coalesce((status == 0) | status.between(200, 299), F.lit(False))


def split_responses(responses: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Succeeded and failed responses, each for its own processing (M4u)."""
    ok = is_ok(F.col(status))
    return responses.where(ok), responses.where(~ok)


def numbered_attempts(log: DataFrame, key: str, order: list[str], retries: int = RETRIES) -> DataFrame:
    """The first attempts per key.

    The rank limit is applied before the shuffle too (WindowGroupLimit), so a
    hot key sends at most ``retries + 1`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("attempt_no", rank).where(F.col("attempt_no") <= retries + 1)


def resolve_attempts(attempts: DataFrame, key: str, retries: int = RETRIES,
                     valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """First ok attempt per key, or one failed record (L1); ``valid`` may rewrite responses first (L2)."""
    tried = attempts.where(F.col("attempt_no") <= retries + 1)
    tried = valid(tried) if valid else tried
    ok = is_ok(F.col("status"))
    won = F.min_by(F.struct("status", "body"), F.when(ok, F.col("attempt_no")))
    grouped = tried.groupBy(key).agg(
        won.alias("won"), F.min(F.when(ok, F.col("attempt_no"))).alias("at"), F.count("*").alias("n"))
    good = F.col("at").isNotNull()
    return grouped.select(
        key,
        F.when(good, F.col("won.status")).otherwise(FAILED_STATUS).cast("int").alias("status"),
        good.alias("ok"),
        F.coalesce(F.col("at").cast("long"), F.col("n")).alias("attempts"),
        F.when(good, F.col("won.body")).otherwise("").alias("body"))


def crawl_counts(responses: DataFrame, by: str) -> DataFrame:
    """Succeeded and failed responses per rule."""
    ok = is_ok(F.col("status"))
    return responses.groupBy(by).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def cookie_header(cookies: DataFrame, by: str, names: list[str] = COOKIE_NAMES,
                  prefixes: list[str] = COOKIE_PREFIXES) -> DataFrame:
    """Allow-listed cookies per group as one header of distinct ``name=value;`` parts, sorted."""
    name = F.trim(F.col("name"))
    allowed = name.isin(names)
    for prefix in prefixes:
        allowed = allowed | name.startswith(prefix)
    parts = cookies.where(allowed).select(
        by, F.concat(name, F.lit("="), F.trim("value"), F.lit(";")).alias("part")).distinct()
    return parts.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("part")), "").alias("header"))


def before_marker(rows: DataFrame, group: list[str], order: str, marker: Column) -> DataFrame:
    """Rows of each group up to and including the first marked one.

    The marker's position is a partially aggregated minimum joined back, so a
    hot group is never gathered in one task the way a running window would.
    """
    stops = rows.where(marker).groupBy(*group).agg(F.min(order).alias("_stop"))
    return rows.join(stops, group, "left").where(
        F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")
