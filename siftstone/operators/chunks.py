"""Chunking by tokens, with overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, slug, stem, strip
from ..session import map_rows

SIZE, OVERLAP = 500, 100


def check_sizes(size: int, overlap: int) -> None:
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ValueError("chunk size must be a positive integer")
    if isinstance(overlap, bool) or not isinstance(overlap, int) or not 0 <= overlap < size:
        raise ValueError("chunk overlap must be at least 0 and below the chunk size")


def by_words(text: str) -> int:
    return len(text.split())


def stride_chunks(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of size white-space tokens, each starting size - overlap after the last: adds chunk_index, total_chunks, token_count and chunk. Blank texts give none;
    a text of one window is kept as it is. No shuffle, no Python."""
    check_sizes(size, overlap)
    step = size - overlap
    tokens = F.split(strip(text), r"\s+")
    t = docs.withColumn("_text", strip(text)).where("_text <> ''").withColumn("_tokens", tokens).withColumn("_n", F.size("_tokens"))
    total = F.when(F.col("_n") <= size, 1).otherwise(F.ceil((F.col("_n") - overlap) / step).cast("int"))
    t = t.withColumn("total_chunks", total).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    part = F.slice("_tokens", F.col("chunk_index") * step + 1, F.lit(size))
    chunk = F.when(F.col("total_chunks") == 1, F.col("_text")).otherwise(F.array_join(part, " "))
    return t.withColumn("token_count", F.size(part)).withColumn("chunk", chunk).drop("_text", "_tokens", "_n")


def pack(text: str, count: Callable[[str], int], size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Greedy packing that keeps white space: pieces end at a space, else at one of separators; a new chunk looks back over at most overlap tokens.
    A piece above size by itself is an error."""
    pieces: list[str] = []
    for part in _split_keep(text, " "):
        pieces += [part] if count(part) <= size else [p for s in separators for p in _split_keep(part, s)]
    out: list[str] = []
    held: list[str] = []
    n = 0
    for piece in pieces:
        c = count(piece)
        if c > size:
            raise RuntimeError(f"a piece has {c} tokens, above the chunk size {size}")
        if held and n + c > size:
            out.append("".join(held))
            while held and (n > overlap or n + c > size):
                n -= count(held.pop(0))
        held.append(piece)
        n += c
    if held:
        out.append("".join(held))
    kept = [x for x in out if x.strip()]
    if any(count(x) > size for x in kept):
        raise RuntimeError(f"a chunk has more tokens than its pieces, above the chunk size {size}")
    return kept


def _split_keep(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    return [p + separator for p in parts[:-1]] + parts[-1:]


def packed_chunks(docs: DataFrame, text: str = "text", kind: str = "source_type", size: int = SIZE, overlap: int = OVERLAP, count: Callable[[str], int] = by_words) -> DataFrame:
    """The packing of pack() over rows; kind must be report or transcript where a text has to be split. Adds the same columns as stride_chunks."""
    check_sizes(size, overlap)
    keep = [f.name for f in docs.schema]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at, sort = keep.index(text), keep.index(kind)

    def packed(*row) -> list[tuple]:
        body = (row[at] or "").strip()
        if not body:
            return []
        n = count(body)
        if n > size and row[sort] not in ("report", "transcript"):
            raise ValueError("source_type must be 'report' or 'transcript'")
        found = [body] if n <= size else pack(body, count, size, overlap, ("\n",) if row[sort] == "transcript" else ("\n\n",))
        return [(*row, [{"chunk_index": i, "total_chunks": len(found), "token_count": count(c), "chunk": c} for i, c in enumerate(found)])]

    # A row's chunks are one array until they are out of Python, so that its text isn't copied for each.
    made = map_rows(docs, f"{ddl}, _chunks array<struct<chunk_index:int,total_chunks:int,token_count:int,chunk:string>>", packed)
    return made.select(*(F.col(f"`{c}`") for c in keep), F.inline("_chunks"))


def chunk_id(mission: str | Column, source: str | Column, index: str | Column) -> Column:
    """slug of mission :: slug of the source's stem :: chunk_0000; null if a slug is empty."""
    a, b = F.nullif(slug(mission), F.lit("")), F.nullif(slug(stem(source)), F.lit(""))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("::", a, b, F.format_string("chunk_%04d", col(index).cast("int"))))
