"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all normalised test items reads each text once.

A text is normalised by lower-casing A-Z and taking every run of a-z, 0-9 and non-ASCII characters as a word; words are joined by
one space. A window is SIZE consecutive words of an item (a shorter item is one window). Every word inside a window's occurrence
is hit; word numbers map back to the original text's offsets.

Null or wordless texts have no words and no hits, null or wordless items no windows; item ids that repeat count once, and a null item id
hits without being counted; texts are scanned as a whole, however long; the result doesn't depend on the order of items; each row of docs
gives one row, repeated rows too; an empty table gives an empty table, and with an empty benchmark nothing is hit.

An automaton takes some 0.4 KB for a character of the items, so a worker holds one of at most SLICE_CHARS characters at a time. One is
enough for all usual test sets. Beyond, a task gathers texts of HELD_CHARS characters and runs them through one slice's automaton
after the other, each built once for so many texts; results are the same. Items are broadcast, at most MAX_CHARS characters, which is checked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import schema_of, ship

SIZE = 10
SLICE_CHARS, MAX_CHARS = 1_000_000, 250_000_000
#: Texts that a task holds at once with one automaton; characters of texts that it holds with several.
ROWS, HELD_CHARS = 1024, 100_000_000
#: Bytes that are no part of a word become a space, A-Z become a-z.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
Item = tuple[object, str]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


@lru_cache(1)
def automaton(items: tuple[Item, ...], size: int):
    """Over " w1 ... wk " of every window; bytes stand as the characters of the same numbers. A window's value: its words, its items."""
    owners: dict[str, set] = {}
    lengths: dict[str, int] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            window = words[i : i + size]
            key = (b" " + b" ".join(window) + b" ").decode("latin-1")
            owners.setdefault(key, set()).add(item)
            lengths[key] = len(window)
    if not owners:
        return None
    machine = ahocorasick.Automaton()
    for key, own in owners.items():
        machine.add_word(key, (lengths[key], len(key), frozenset(own)))
    machine.make_automaton()
    return machine


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set]:
    """Words, merged runs of hit words as (first, after the last), and the items found."""
    words = words_of(text)
    if not words or machine is None:
        return len(words), [], set()
    runs: list[list[int]] = []
    found: set = set()
    starts = None
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    for end, (count, length, own) in machine.iter(joined):
        if starts is None:
            starts = np.cumsum([0, *(len(w) + 1 for w in words)])  # of each word's space before it
        first = int(np.searchsorted(starts, end - length + 1))
        found |= own
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], first + count)
            runs[-1][0] = min(runs[-1][0], first)
        else:
            runs.append([first, first + count])
    return len(words), merged(runs), found


def merged(runs) -> list[tuple[int, int]]:
    """Runs that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, runs)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of runs of words in the original text."""
    at = [m.span() for m in WORD.finditer(text)] if runs else []
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def slices(benchmark: DataFrame, chars: int) -> list[Broadcast]:
    """The items, each once for a text, in broadcast slices of a bounded size."""
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    if (total := rows.agg(F.sum(F.length("text"))).first()[0] or 0) > MAX_CHARS:
        raise ValueError(f"the benchmark has {total} characters, above {MAX_CHARS}: give its parts one by one")
    out: list[list[Item]] = [[]]
    size = 0
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        if size + len(text) > chars and out[-1]:
            out.append([])
            size = 0
        out[-1].append((item, text))
        size += len(text)
    return [benchmark.sparkSession.sparkContext.broadcast(tuple(x)) for x in out]


def gathered(batches: Iterable[Any], texts: Callable[[Any], list[str | None]], parts: list[Broadcast], size: int, look: Callable, join: Callable) -> Iterator[tuple[Any, list]]:
    """Each batch with look(text, automaton) of its texts, joined over the slices. With one slice a batch goes through by itself; with several, batches of HELD_CHARS characters wait for each automaton in turn."""
    if len(parts) == 1:
        machine = automaton(parts[0].value, size)
        for batch in batches:
            yield batch, [look(t, machine) for t in texts(batch)]
        return
    held: list[Any] = []
    n = 0

    def done():
        found: list[list] = [[] for _ in held]
        for part in parts:
            machine = automaton(part.value, size)
            for k, batch in enumerate(held):
                now = [look(t, machine) for t in texts(batch)]
                found[k] = list(map(join, found[k], now)) if found[k] else now
        return zip(held, found, strict=True)

    for batch in batches:
        held.append(batch)
        n += sum(len(t) for t in texts(batch) if t)
        if n >= HELD_CHARS:
            yield from done()
            held, n = [], 0
    yield from done()


def both(a: tuple[int, list, set], b: tuple[int, list, set]) -> tuple[int, list, set]:
    """scan() over two slices."""
    return a[0], merged(a[1] + b[1]), a[2] | b[2]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, chars: int = SLICE_CHARS) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_words, spans of hit text (start, end in code points), n_hit words and the sorted items, as strings. Other columns are not read."""
    ddl = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, n_hit long, items array<string>"
    parts = slices(benchmark, chars)
    schema = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))
        for batch, found in gathered(few, lambda b: b.column("text").to_pylist(), parts, size, scan, both):
            out = []
            for doc_id, text, (n, runs, items) in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), found, strict=True):
                spans = [{"start": a, "end": b} for a, b in offsets(text or "", runs)]
                out.append((doc_id, n, spans, sum(b - a for a, b in runs), sorted(str(x) for x in items if x is not None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, chars: int = SLICE_CHARS) -> DataFrame:
    """The rows of docs, all columns, without those that hold a window of the benchmark."""
    hit = flagged(docs, benchmark, size, chars)
    return docs.where(~hit)


def flagged(docs: DataFrame, benchmark: DataFrame, size: int, chars: int):
    """A column over docs: whether text holds a window. Evaluated beside the row, so texts are not shuffled."""
    ship(docs.sparkSession)
    parts = slices(benchmark, chars)

    @F.pandas_udf("boolean")
    def held(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for _, found in gathered(texts, list, parts, size, hits, bool.__or__):
            yield pd.Series(found, dtype=bool)

    return held(F.col("text"))


def hits(text: str | None, machine) -> bool:
    words = words_of(text)
    return bool(words) and machine is not None and next(machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")), None) is not None


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, w, least(len(w), {SIZE}) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
p AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, i, p.k, item_id FROM p JOIN win ON p.x = win.x AND p.k = win.k),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM hit) GROUP BY r),
t AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
