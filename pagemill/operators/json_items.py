"""Records from JSON documents (A4, E5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.common import WHITESPACE, let
from pagemill.functions.jsonpath import at_path, json_error, json_path


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON documents from files, one per file or one per line: file, doc, error, and for lines the ``block`` of the file (A4).

    ``doc`` is a variant; a broken document has none and says so in ``error``
    with its beginning, and a line of white space is no document.
    """
    keep = ["file", "block"] if lines else ["file"]
    places = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")}
    rows = spark.read.text(path, wholetext=not lines).select(*(places[k].alias(k) for k in keep), "value")
    if lines:
        rows = rows.where(F.btrim(F.col("value"), F.lit(WHITESPACE)) != "")
    parsed = rows.select(*keep, "value", F.try_parse_json("value").alias("doc"))
    return parsed.select(*keep, "doc", F.when(F.col("doc").isNull(), F.concat(F.lit("no JSON: "), F.substring("value", 1, 40))).alias("error"))


def write_documents(rows: DataFrame, doc: str, path: str) -> None:
    """One document per line."""
    rows.select(F.replace(F.replace(F.col(doc), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" ")).alias("value")).write.text(path)


@dataclass(frozen=True)
class JsonField:
    """Value below successive keys; without keys the default."""

    select: str | None = None
    default: str | None = None


Hook = Callable[[Column], Column]


def _elements(doc: Column, target: str | None) -> Column:
    """Elements of the list at the target; a single object counts as one, but only at the root."""
    def spread(part: Column) -> Column:
        is_list = F.schema_of_variant(part).startswith("ARRAY")
        alone = F.array(part) if target is None else F.lit(None)
        return F.when(is_list, part.cast("array<variant>")).otherwise(alone)

    part = at_path(doc, target) if target else doc
    return F.when(part.isNotNull(), let(part, spread))


def _parsed(rows: DataFrame, doc: str, target: str | None, outer: bool) -> DataFrame:
    explode = F.posexplode_outer if outer else F.posexplode
    keep = [c for c in rows.columns if c != doc]
    given = F.col(doc) if isinstance(rows.schema[doc].dataType, T.VariantType) else F.try_parse_json(doc)
    parsed = rows.select(*keep, given.alias("_doc"))
    return parsed.select(*keep, explode(_elements(F.col("_doc"), target)).alias("pos", "_record"))


def _error(fields: dict[str, JsonField]) -> Column:
    record = F.col("_record")
    return F.coalesce(*(F.concat(F.lit(f"{n}: "), json_error(record, f.select)) for n, f in fields.items()))


def records(rows: DataFrame, doc: str, fields: dict[str, JsonField], target: str | None = None,
            clean: dict[str, Hook] | None = None, ignore: dict[str, Hook] | None = None) -> DataFrame:
    """One row per record with its position; ignored records are flagged, not dropped.

    Records with a missing key carry ``error``.
    """
    clean, ignore = clean or {}, ignore or {}
    keep = [c for c in rows.columns if c != doc]
    columns, ignored = [], F.lit(False)
    for name, field in fields.items():
        value = json_path(F.col("_record"), field.select, field.default)
        skip = F.coalesce(ignore[name](value), F.lit(False)) if name in ignore else F.lit(False)
        ignored = ignored | skip
        if name in clean:
            value = F.when(skip, value).otherwise(clean[name](value))
        columns.append(value.alias(name))
    return _parsed(rows, doc, target, outer=False).select(
        *keep, "pos", *columns, ignored.alias("ignored"), _error(fields).alias("error"))


def record_errors(rows: DataFrame, doc: str, fields: dict[str, JsonField], target: str | None = None) -> DataFrame:
    """Documents without records and records with a missing key."""
    keep = [c for c in rows.columns if c != doc]
    error = F.when(F.col("_record").isNull(), F.lit(f"no records in {target or 'document'}")).otherwise(_error(fields))
    return _parsed(rows, doc, target, outer=True).select(*keep, "pos", error.alias("error")).where(
        F.col("error").isNotNull())
