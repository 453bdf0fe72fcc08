"""Records to one document per file, and how turns and blocks are written in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, strip


def span(name: str, start: str | Column, end: str | Column) -> Column:
    """name=a-b; null without a start; the end falls back to it."""
    s, e = col(start), col(end)
    return F.when(s.isNotNull(), F.concat(F.lit(f"{name}="), s.cast("string"), F.lit("-"), F.coalesce(e, s).cast("string")))


def turn(index, text, time=None, speaker=None, line_start=None, line_end=None, valid=None) -> Column:
    """[utt=000001 time=... speaker=... lines=a-b time_valid=false] and the text on the next line; absent parts are left out."""
    named = lambda n, c: F.when(F.nullif(col(c), F.lit("")).isNotNull(), F.concat(F.lit(f"{n}="), col(c)))
    tags = [F.format_string("utt=%06d", col(index).cast("long"))]
    tags += [named(n, c) for n, c in (("time", time), ("speaker", speaker)) if c is not None]
    tags += [span("lines", line_start, line_end)] if line_start is not None else []
    tags += [F.when(~col(valid), F.lit("time_valid=false"))] if valid is not None else []
    return F.concat(F.lit("["), F.concat_ws(" ", *tags), F.lit("]\n"), strip(text))


def block(index, text, page_start, page_end) -> Column:
    return F.concat(F.lit("["), F.concat_ws(" ", F.format_string("block=%05d", col(index).cast("long")), span("pages", page_start, page_end)), F.lit("]\n"), strip(text))


def one_per_file(records: DataFrame, path: str, order: str, rendered: str, separator: str, single: list[str] = (), low: str | None = None, high: str | None = None) -> DataFrame:
    """Groups records by path, in order: text, record_count, n_<c> (distinct values of each column that must be single-valued) and that value, bounds of low and high. A file is
    gathered in one task, as its text is one value."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rendered).alias("t"))))
    aggs = [F.array_join(F.transform(parts, lambda x: x.t), separator).alias("text"), F.count("*").alias("record_count")]
    aggs += [x for c in single for x in (F.min(c).alias(c), F.count_distinct(c).alias(f"n_{c}"))]
    aggs += [F.min(low).alias("first"), F.max(high or low).alias("last")] if low else []
    return records.groupBy(path).agg(*aggs)
