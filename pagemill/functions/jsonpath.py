"""Path lookups in JSON documents held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_path(doc: Column, select: str) -> Column:
    """The part of the document below successive keys, ``a>b>c``; NULL where a key is missing."""
    path = "$" + "".join(f"['{key}']" for key in select.split(">"))
    return F.variant_get(doc, path, "variant")


def as_text(part: Column) -> Column:
    """Scalars as text, objects and lists as JSON, JSON null as NULL."""
    return F.when(~F.is_variant_null(part), part.cast("string"))


def json_path(doc: Column, select: str | None, default: str | None = None) -> Column:
    """Value at the path as text; an empty selector gives the default."""
    return as_text(at_path(doc, select)) if select else F.lit(default).cast("string")


def json_error(doc: Column, select: str | None) -> Column:
    """Message where a key is missing (a null value is not), NULL elsewhere."""
    missing = at_path(doc, select).isNull() if select else F.lit(False)
    return F.when(missing, F.lit(f"no key {select}"))
