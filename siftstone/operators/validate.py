"""Constraints as violation counts, from one aggregation each; the driver raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# What every record says of itself.
REQUIRED = ("collection", "mission", "source", "source_type", "source_file", "source_path", "doc_id")


def blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == ""


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): rows that break each, in one pass."""
    counted = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    return counted.unpivot([], list(checks), "check", "n")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def record_checks(metadata: dict[str, str]) -> dict[str, Column]:
    """metadata: column of each required key (a missing one is a violation of every row)."""
    out = {"blank_id": blank("id"), "blank_document": blank("document")}
    out |= {f"missing_{k}": F.col(metadata[k]).isNull() if k in metadata else F.lit(True) for k in REQUIRED}
    return out


def bounds(low: str, high: str) -> Column:
    """A bound alone, one below 1, or ends in the wrong order."""
    a, b = F.col(low), F.col(high)
    return (a.isNull() & b.isNotNull()) | (a.isNotNull() & b.isNull()) | (a < 1) | (b < a)


def validate_records(records: DataFrame) -> DataFrame:
    """records(id, document, metadata struct): returned if whole, else ValueError with the counts. An empty table is valid."""
    missing = {"id", "document", "metadata"} - set(records.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    fields = records.schema["metadata"].dataType.fieldNames()
    absent = [k for k in REQUIRED if k not in fields]
    if absent:
        raise ValueError(f"missing metadata: {absent}")
    checks = record_checks({k: f"metadata.{k}" for k in REQUIRED})
    for kind, (a, b) in {"report": ("page_start", "page_end"), "transcript": ("source_line_start", "source_line_end")}.items():
        if a in fields and b in fields:
            checks[f"{kind}_bounds"] = (F.col("metadata.source_type") == kind) & (F.col(f"metadata.{a}").isNull() | F.col(f"metadata.{b}").isNull() | bounds(f"metadata.{a}", f"metadata.{b}"))
    found = {r["check"]: r["n"] for r in violations(records, checks).collect() if r["n"]}
    for name, key in (("duplicate_id", "id"), ("duplicate_source", "metadata.source")):
        if n := duplicates(records.select(F.col(key).alias("k")), "k").count():
            found[name] = n
    if found:
        raise ValueError("invalid records: " + ", ".join(f"{k}={n}" for k, n in sorted(found.items())))
    return records


def any_of(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, cs)
