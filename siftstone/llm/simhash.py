"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS = 3 bits meet as follows. Blank out one of BLOCKS blocks of bits: for some block that holds at
least one of the differing bits, at most two bits differ in the rest. Each fingerprint emits, for each block, the rest and all
its one-bit variants - the ball of half the radius; two rests within two bits share a variant. Fingerprints are shuffled on
variants, and those that collide are verified over all 64 bits. A fingerprint emits 132 variants, however many others there are.

Rows of one variant never make all pairs: up to DENSE of them are linked by the tree of their verified links. A variant that
more share hands its fingerprints to a second step, which emits the one-bit and the two-bit variants of all 64 bits; there all
that share a variant with a one-bit member are tied to it alone, which is exact without verification.

Equal fingerprints count once before any of this, so groups of copies cost one row each.
Null texts, empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows, and rows
whose doc_id repeats, each keep their row; a null doc_id never names a component unless all of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BROADCAST_ROWS, PART_BYTES, checkpoint, hot_values, map_rows, plain_name, salted_join, schema_of, ship
from .components import components

RADIUS = 3
SHINGLE = 3
BLOCKS = 3
SEED = 42
#: Fingerprints of one variant whose links are verified in one go.
DENSE = 2048
#: Variants of a fingerprint: rests of BLOCKS blocks with their one-bit variants; up to two bits of all 64.
NARROW, WIDE = BLOCKS + 2 * 64, 1 + 64 + 2 * 32 * 31 // 2
#: Below this, all pairs of a variant are compared by shifting.
FEW = 8


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], np.uint64)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n = len(words) - size + 1
    return np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)), np.uint64, n)


def fingerprint(text: str | None) -> int:
    """A bit is set if it is in more than half of the hashes; signed, as Spark holds 64 bits."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):  # a byte holds 255
        counts += np.add.reduce(np.unpackbits(h[i : i + 255].view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(h)).view(np.int64)[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns and fp of each row of docs(text, keep)."""
    ddl = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", fp long"
    return map_rows(docs.select("text", *keep), ddl, lambda: lambda text, *kept: (*kept, fingerprint(text)))


def masks(blocks: int = BLOCKS) -> list[int]:
    """Bits of each block."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(1 << p for p in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """One row for each fingerprint: for every block, the rest and its one-bit variants. The blanked block holds the block's number, so that rests of different blocks seldom meet; where they do, verification drops them."""
    fp = fp.astype(np.uint64)[:, None]
    out = []
    for k, mask in enumerate(masks(blocks)):
        flips = [0, *(1 << p for p in range(64) if not mask >> p & 1)]
        mark = (k + 1) * (mask & -mask)
        out.append((fp & np.uint64(~mask & (1 << 64) - 1) | np.uint64(mark)) ^ np.array(flips, np.uint64))
    return np.concatenate(out, axis=1)


def _stream(df: DataFrame, ddl: str, f) -> DataFrame:
    """f: from an iterator of record batches to one of column lists."""
    ship(df.sparkSession)
    schema = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def _emit(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for i in range(0, len(fp), 1000):
            part = fp[i : i + 1000]
            v = variants(part)
            yield v.reshape(-1).view(np.int64), np.repeat(part, v.shape[1])


def forest(fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """A tree of the verified links for each connected part of the distinct fingerprints fp: breadth first, each reached once."""
    left, front = fp, fp[:0]
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        near = np.bitwise_count((left ^ front[0]).view(np.uint64)) <= radius
        for x in left[near].tolist():
            yield int(front[0]), x
        front, left = np.concatenate([front[1:], left[near]]), left[~near]


def _collide(batches, dense: int = DENSE):
    """From rows sorted by (z, fp): verified links; (fp, fp) for members of a variant that more than dense share."""
    held_z, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot: int | None = None

    def links(z: np.ndarray, fp: np.ndarray):
        """Of whole variants."""
        if not len(z):
            return
        cuts = np.flatnonzero(np.r_[True, z[1:] != z[:-1]])
        size = np.diff(np.r_[cuts, len(z)])
        a, b = [], []
        small = np.repeat((size > 1) & (size <= FEW), size)
        zs, fs = z[small], fp[small]
        for s in range(1, FEW):
            near = np.flatnonzero((zs[s:] == zs[:-s]) & (np.bitwise_count((fs[s:] ^ fs[:-s]).view(np.uint64)) <= RADIUS)) if len(zs) > s else []
            a.append(fs[near]) if len(near) else None
            b.append(fs[near + s]) if len(near) else None
        large = [(x, y) for c, n in zip(cuts[size > FEW], size[size > FEW], strict=True) for x, y in (forest(fp[c : c + n]) if n <= dense else ((f, f) for f in fp[c : c + n].tolist()))]
        if large:
            a.append(np.array([x for x, _ in large], np.int64))
            b.append(np.array([y for _, y in large], np.int64))
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pairs[:, 0], pairs[:, 1]

    for batch in batches:
        z = np.concatenate([held_z, batch.column("z").to_numpy()])
        fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
        once = np.r_[True, (z[1:] != z[:-1]) | (fp[1:] != fp[:-1])][: len(z)]  # rests of two blocks may give one variant
        z, fp = z[once], fp[once]
        if hot is not None:  # the variant that went over dense goes on
            n = int(np.searchsorted(z != hot, True)) if (z != hot).any() else len(z)
            if n:
                yield fp[:n], fp[:n]
            z, fp = z[n:], fp[n:]
            if len(z):
                hot = None
        if not len(z):
            held_z, held_fp = z, fp
            continue
        last = len(z) - int(np.argmax((z != z[-1])[::-1])) if (z != z[-1]).any() else 0
        yield from links(z[:last], fp[:last])
        held_z, held_fp = z[last:], fp[last:]
        if len(held_z) > dense:
            hot = int(held_z[0])
            yield held_fp, held_fp
            held_z, held_fp = held_z[:0], held_fp[:0]
    yield from links(held_z, held_fp)


def _emit_wide(batches):
    """One-bit variants of all 64 bits by every fingerprint (side 0), and two-bit variants by those of odd weight (side 1): fingerprints three bits apart differ in parity, so one of them emits either. Of any three bits two fall in one half, so pairs within halves do."""
    one = np.array([0, *(1 << p for p in range(64))], np.uint64)
    two = np.array([1 << i | 1 << j for lo in (0, 32) for i in range(lo, lo + 32) for j in range(i + 1, lo + 32)], np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for i in range(0, len(fp), 500):
            part = fp[i : i + 500]
            odd = part[np.bitwise_count(part.view(np.uint64)) % 2 == 1]
            for side, own, flips in ((0, part, one), (1, odd, two)):
                if len(own):
                    v = own.view(np.uint64)[:, None] ^ flips
                    yield v.reshape(-1).view(np.int64), np.full(v.size, side, np.int8), np.repeat(own, v.shape[1])


def spread_out(fps: DataFrame, bytes_each: int) -> DataFrame:
    """fps(fp) in so many parts that what each emits, at bytes_each for a fingerprint, stays near PART_BYTES."""
    return fps.repartition(max(1, -(-fps.count() * bytes_each // PART_BYTES)), "fp")


def wide_links(hot: DataFrame) -> DataFrame:
    """Links (a, b) among hot(fp) that have the components of all links within RADIUS: each variant's members are tied to its least one-bit member. They are at most 1 + 1 or 1 + 2 bits apart."""
    emitted = _stream(spread_out(hot, WIDE * 17), "z long, side byte, fp long", _emit_wide)
    anchor = emitted.where("side = 0").groupBy("z").agg(F.min("fp").alias("a"))
    return emitted.join(anchor, "z").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links among distinct(fp), enough for the components of all that are within RADIUS bits. dense: fingerprints of one variant that are verified in one go."""
    emitted = _stream(spread_out(distinct.select("fp"), NARROW * 16), "z long, fp long", _emit)
    met = checkpoint(_stream(emitted.repartition("z").sortWithinPartitions("z", "fp"), "a long, b long", lambda batches: _collide(batches, dense)).distinct())
    hot = met.where("a = b").select(F.col("a").alias("fp")).distinct()
    near = met.where("a <> b")
    return near if met.where("a = b").isEmpty() else near.union(wide_links(checkpoint(hot)))


def near_duplicates(docs: DataFrame, *keep: str) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, keep columns, fp, root, the fingerprint that stands for the component, and component_id, the smallest doc_id that links reach. Only root tells components apart: doc_ids may repeat or all be null."""
    prints = checkpoint(fingerprints(docs, *dict.fromkeys(("doc_id", *keep))))
    own = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    stars = components(links(own)).select(F.col("node").alias("fp"), "root")
    rooted = own.select("fp", "least").join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Fingerprints of one component may be many: its name goes back to them like a hot key's.
    rooted = checkpoint(rooted)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = salted_join(rooted, names.select("root", "component_id"), hot_values(names, "root"), "root").select("fp", "root", "component_id")
    return salted_join(prints, named, hot_values(own, "fp"), "fp")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, all columns, but of each component only one: its smallest doc_id, then its first row.

    Rows are told by monotonically_increasing_id, which is the same in every scan of the same files in the same splits: docs must be a scan (with or without filters) or a
    checkpoint. The rows that go are counted; up to broadcast_rows of their numbers travel to the texts, beyond, texts meet them in a shuffle."""
    whole, uid = F.struct(*map(plain_name, docs.columns)).alias("_doc"), F.monotonically_increasing_id().alias("_uid")
    found = checkpoint(near_duplicates(docs.select("doc_id", "text", uid), "_uid"))
    first = found.groupBy("root").agg(F.min_by("_uid", F.struct(F.col("doc_id").isNull(), "doc_id", "_uid")).alias("_uid"))
    gone = checkpoint(found.select("_uid").join(first.select("_uid"), "_uid", "left_anti"))
    few = gone.count() <= broadcast_rows
    return docs.select(whole, uid).join(F.broadcast(gone) if few else gone, "_uid", "left_anti").select("_doc.*")
