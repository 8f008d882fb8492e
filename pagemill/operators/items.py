"""Records from pages: scopes, fields, clean hooks, ignore filters, row rejection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.common import let
from pagemill.operators.fields import Field
from pagemill.operators.select import Selector, select


@dataclass(frozen=True)
class ItemSpec:
    """Fields of a record; with a scope, one record per scope element.

    clean: field -> Column function rewriting the value (M1u).
    ignore: field -> predicate on the uncleaned value; an ignored value is not
    cleaned, and records with one are dropped when many are asked for (C9).
    """

    fields: dict[str, Field]
    scope: Selector | None = None
    first_scope_only: bool = False
    clean: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    ignore: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def _record(spec: ItemSpec, nodes: Column, scope: Column | None) -> Column:
    parts = [f.extract(nodes, scope).alias(name) for name, f in spec.fields.items()]
    at = scope["pre"] if scope is not None else F.lit(0)
    return F.struct(at.alias("scope_pre"), *parts)


def _records(spec: ItemSpec, nodes: Column) -> Column:
    scopes = select(nodes, spec.scope)
    scopes = F.slice(scopes, 1, 1) if spec.first_scope_only else scopes
    return F.transform(scopes, lambda s: _record(spec, nodes, s))


def _first_error(spec: ItemSpec, record: Column) -> Column:
    return F.coalesce(*(F.when(record[n]["error"].isNotNull(), F.concat(F.lit(n + ": "), record[n]["error"]))
                        for n in spec.fields))


def _finish(rows: DataFrame, spec: ItemSpec, keep: list[str]) -> DataFrame:
    ignored = F.lit(False)
    columns = []
    for name in spec.fields:
        value = F.col("record")[name]["value"]
        if name in spec.ignore:
            skip = F.coalesce(spec.ignore[name](value), F.lit(False))
            ignored = ignored | skip
            cleaned = F.when(skip, value).otherwise(spec.clean[name](value)) if name in spec.clean else value
        else:
            cleaned = spec.clean[name](value) if name in spec.clean else value
        columns.append(cleaned.alias(name))
    return rows.select(*keep, F.col("record.scope_pre").alias("scope_pre"), *columns,
                       ignored.alias("ignored"), _first_error(spec, F.col("record")).alias("error"))


def page_items(parsed: DataFrame, spec: ItemSpec) -> DataFrame:
    """One record per page; ignored records are kept and flagged."""
    keep = [c for c in parsed.columns if c != "nodes"]
    return _finish(parsed.select(*keep, _record(spec, F.col("nodes"), None).alias("record")), spec, keep)


def scope_items(parsed: DataFrame, spec: ItemSpec, strict: bool = False) -> DataFrame:
    """One record per scope element; ignored records are dropped.

    strict: keep only the records before the page's first failing one, as a
    row-by-row writer stops there; otherwise failing records carry ``error``.
    """
    keep = [c for c in parsed.columns if c != "nodes"]
    records = _records(spec, F.col("nodes"))
    if strict:
        def before_first_error(all_records: Column) -> Column:
            failing = F.filter(all_records, lambda r: _first_error(spec, r).isNotNull())
            return let(F.get(failing, F.lit(0))["scope_pre"], lambda stop: F.filter(
                all_records, lambda r: stop.isNull() | (r["scope_pre"] < stop)))
        records = let(records, before_first_error)
    rows = parsed.select(*keep, F.explode(records).alias("record"))
    return _finish(rows, spec, keep).where(~F.col("ignored")).drop("ignored")


def scope_outcomes(parsed: DataFrame, spec: ItemSpec) -> DataFrame:
    """Records and errors in one pass: ``error`` is set for failing records and for pages without a scope element."""
    keep = [c for c in parsed.columns if c != "nodes"]
    rows = parsed.select(*keep, F.explode_outer(_records(spec, F.col("nodes"))).alias("record"))
    error = F.when(F.col("scope_pre").isNull(), "no scope element").otherwise(F.col("error"))
    return _finish(rows, spec, keep).withColumn("error", error)


def scope_errors(parsed: DataFrame, spec: ItemSpec) -> DataFrame:
    """Failing records and pages without any scope element."""
    keep = [c for c in parsed.columns if c != "nodes"]
    return scope_outcomes(parsed, spec).select(*keep, "scope_pre", "error").where(F.col("error").isNotNull())
