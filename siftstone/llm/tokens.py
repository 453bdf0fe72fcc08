"""Token counts without token ids: pieces once for each distinct pre-token, times its frequency in each document.

A tokenizer's model sees one pre-token at a time, so a text's count is the sum over its pre-tokens. A first scan gathers the corpus's
pre-tokens with how often each stands there, but for those that a task meets once; the model counts the pieces of the frequent ones, and a second scan takes each
document's pre-token frequencies. Pre-tokens that are at least 1 / HEAD_ROWS of all that the first scan told of,
which are fewer than HEAD_ROWS whatever the table's size, travel to every task as a dictionary; each of the others stands
in fewer documents than that share and one for each piece that a task handed on, so that none is a hot key. A task hands a pre-token of these on once for many documents, with
rows and frequencies as an array; all that is said of it meets in one place, where the model counts its pieces once.

Pre-tokens are the library's own. Where the pre-tokenizer is the byte-level one, a space between two characters that are no white space always
begins a pre-token and nothing reaches across it, so texts are cut there first and each distinct piece is looked at once: a word of Latin letters,
with or without ASCII signs after it, is that word and those signs; all other pieces are cut by the library. Strings of added tokens
inside a text are one token each, as the library takes them by default.

A null or empty text has 0 tokens; a text is read as a whole, however long; repeated rows and repeated or null ids are rows of
their own; an empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship

#: Pre-tokens that travel to every task are fewer; longer ones are told by their digest there.
HEAD_ROWS, WHOLE = 500_000, 64
#: Times that a pre-token must stand in what a task gathers to be told of. Rare (pre-token, document) pairs that a task gathers before it hands them on, those of a pre-token together; pre-tokens in a batch of what it hands on.
LEAST, PAIRS, GROUPS = 2, 500_000, 10_000
#: Distinct pieces that a task remembers or gathers before it hands them on; characters of texts that it gathers them from.
HELD, GATHERED = 300_000, 64 << 20
#: Tokens beyond which a document is over the limit.
LIMIT = 1024
LONE_SPACE, OTHER_SPACE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])"), re.compile(r" [\s\u180e]|[\s\u180e] |^ | \Z")
#: Words of letters that are letters in every version of Unicode, and signs; a space in the byte-level alphabet.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
SPACE = "\u0120"
#: The byte-level alphabet: bytes that print in Latin-1 are written as themselves, the others, in order, as the characters from 256 on.
PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTING)}


def _key(p: str) -> str:
    return p if len(p) <= WHOLE else hashlib.sha256(p.encode()).hexdigest()


class Splitter:
    """Pre-tokens and piece counts of the tokenizer that spec (its JSON) describes."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        told, self.library = json.loads(spec), Tokenizer.from_str(spec)
        added = told.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or (a["normalized"] and told.get("normalizer")) for a in added):
            raise ValueError("an added token that takes its neighbours along, or is looked for in normalised text, can't be cut out beforehand")
        # The longest of those that begin at the leftmost place.
        self.added = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        pre = told.get("pre_tokenizer") or {}
        self.bytewise = not told.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.known: dict[str, tuple[str, ...]] = {}

    def _library_pre_tokens(self, text: str) -> tuple[str, ...]:
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        if self.library.pre_tokenizer is None:
            return (text,) if text else ()
        return tuple(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))

    def after_space(self, piece: str) -> tuple[str, ...]:
        """The pre-tokens of a piece and the space before it."""
        if m := SIMPLE.fullmatch(piece):
            word, signs = m.groups()
            word = SPACE + (word if word.isascii() else word.encode().decode("latin-1").translate(ALPHABET))
            return (word, signs) if signs else (word,)
        if (found := self.known.get(piece)) is None:
            found = self._library_pre_tokens(" " + piece)
            if len(piece) <= WHOLE:
                if len(self.known) >= HELD:
                    self.known.clear()
                self.known[piece] = found
        return found

    def cut(self, text: str) -> tuple[list[str], list[str], int]:
        """Pre-tokens of what no space is before, pieces that a lone space is before, and the number of added tokens."""
        parts = self.added.split(text) if self.added else [text]
        own, pieces = [], []
        for part in filter(None, parts):
            if self.bytewise:
                # Where no other white space is beside a space, all spaces are lone.
                found = LONE_SPACE.split(part) if OTHER_SPACE.search(part) else part.split(" ")
                part, pieces = found[0], pieces + found[1:] if pieces else found[1:]
            own += self._library_pre_tokens(part)
        return own, pieces, len(parts) - 1

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """The frequencies of a text's pre-tokens, and the number of added tokens in it."""
        own, pieces, n = self.cut(text)
        out = Counter(own)
        for piece, k in Counter(pieces).items():
            for p in self.after_space(piece):
                out[p] += k
        return out, n

    def weigh(self, text: str, common: dict[str, int]) -> tuple[int, dict[str, int]]:
        """The tokens of a text's pre-tokens that common knows of, added tokens included, and the frequencies of its others."""
        own, pieces, n = self.cut(text)
        others: dict[str, int] = {}
        for p in own:
            if (k := common.get(_key(p))) is None:
                others[p] = others.get(p, 0) + 1
            else:
                n += k
        after, get = self.after_space, common.get
        for piece, times in Counter(pieces).items():
            for p in after(piece):
                if (k := get(p if len(p) <= WHOLE else _key(p))) is None:
                    others[p] = others.get(p, 0) + times
                else:
                    n += times * k
        return n, others

    def pieces(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))


def read_spec(path: str) -> str:
    """A tokenizer's JSON, read on the driver and sent along: executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _gather(spec, least: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(p, times): pre-tokens that stand at least so often in what a task has read, and how often. Pieces are gathered first, and each of them is cut once."""

    def run(batches):
        splitter, held, pieces, size = Splitter(spec.value), Counter(), Counter(), 0

        def told():
            for piece, n in pieces.items():
                for p in splitter.after_space(piece):
                    held[p] += n
            some = held if least < 2 else {p: n for p, n in held.items() if n >= least}
            return pa.RecordBatch.from_pydict({"p": pa.array(some.keys(), pa.string()), "times": pa.array(some.values(), pa.int64())})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own, found, _ = splitter.cut(text or "")
                held.update(own)
                pieces.update(found)
                size += len(text or "")
                if len(held) + len(pieces) >= HELD or size > GATHERED:
                    yield told()
                    held, pieces, size = Counter(), Counter(), 0
        if held or pieces:
            yield told()

    return run


def frequencies(docs: DataFrame, spec, least: int = 1) -> DataFrame:
    """(p, times): each distinct pre-token of docs(text) and how often it stands there; what stands less often in what a task gathers doesn't count. spec: broadcast JSON."""
    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(_gather(spec, least), "p string, times long").groupBy("p").agg(F.sum("times").alias("times"))


def with_pieces(found: DataFrame, spec) -> DataFrame:
    """found(p, times) with what the model makes of each."""

    def count(batches):
        splitter = Splitter(spec.value)
        for batch in batches:
            n = [splitter.pieces(p) for p in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["p", "times", "pieces"])

    return found.mapInArrow(count, "p string, times long, pieces long")


def vocabulary(docs: DataFrame, spec) -> DataFrame:
    """(p, times, pieces): each distinct pre-token of docs(text), how often it stands there, and what the model makes of it. spec: broadcast JSON."""
    return checkpoint(with_pieces(frequencies(docs, spec), spec))


def _sums(spec, head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document a line without a pre-token, with the tokens that head knows of; for each other pre-token the documents that have it: their rows' numbers, each with
    how often."""

    def run(batches):
        splitter, common = Splitter(spec.value), head.value
        rest, rows, times = [], [], []

        def told():
            pairs = pa.table({"p": pa.array(rest, pa.string()), "rows": pa.array(rows, pa.int64()), "f": pa.array(times, pa.int64())})
            met = pairs.group_by("p", use_threads=False).aggregate([("rows", "list"), ("f", "list")]).combine_chunks()
            for b in met.to_batches(GROUPS):
                r, f = b.column("rows_list"), b.column("f_list")
                at = np.stack([r.flatten().to_numpy(), f.flatten().to_numpy()], axis=1).reshape(-1)
                ends = 2 * np.concatenate([[0], np.cumsum(r.value_lengths().to_numpy())])
                none = [pa.nulls(b.num_rows, t) for t in (kind, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("p"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at)), *none], names=names)

        kind, names = None, ["p", "at", "doc_id", "n_bytes"]
        for batch in batches:
            kind, sums, own = batch.schema.field("doc_id").type, [], batch.column("row").to_pylist()
            for row, text in zip(own, batch.column("text").to_pylist(), strict=True):
                n, others = splitter.weigh(text or "", common)
                rest += others.keys()
                times += others.values()
                rows += [row] * len(others)
                sums.append(n)
            at = pa.ListArray.from_arrays(pa.array(range(0, 2 * len(own) + 1, 2), pa.int32()), pa.array([x for pair in zip(own, sums, strict=True) for x in pair], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.string()), at, batch.column("doc_id"), batch.column("n_bytes")], names=names)
            if len(rest) >= PAIRS:
                yield from told()
                rest, rows, times = [], [], []
        if rest:
            yield from told()

    return run


def _parts(spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What _sums tells, in order of p, as (row, doc_id, n_bytes, n): each pre-token's pieces are counted once."""

    def run(batches):
        splitter, last, n = Splitter(spec.value), None, 1
        for batch in batches:
            pieces = []
            for p in batch.column("p").to_pylist():
                if p != last:
                    last, n = p, 1 if p is None else splitter.pieces(p)
                pieces.append(n)
            at = batch.column("at")
            which = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy() // 2)
            pairs = at.flatten().to_numpy().reshape(-1, 2)
            told = [batch.column(c).take(pa.array(which)) for c in ("doc_id", "n_bytes")]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), *told, pa.array(pairs[:, 1] * np.array(pieces, np.int64)[which])], names=["row", "doc_id", "n_bytes", "n"])

    return run


def token_counts(docs: DataFrame, path: str, head_rows: int = HEAD_ROWS) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_bytes, n_tokens), a row for each row. path: a tokenizer's JSON. head_rows: pre-tokens that travel are fewer."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(path))
    known = checkpoint(frequencies(docs, spec, LEAST))
    total = known.agg(F.sum("times")).first()[0] or 0
    frequent = total // head_rows + 1  # total / frequent < head_rows
    key = F.when(F.length("p") <= WHOLE, F.col("p")).otherwise(F.sha2("p", 256))
    common = with_pieces(known.where(F.col("times") >= frequent), spec).select(key.alias("p"), "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(common["p"].to_pylist(), common["pieces"].to_pylist(), strict=True)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    told = rows.mapInArrow(_sums(spec, head), f"p string, at array<long>, doc_id {kind}, n_bytes long")
    # A document's own part rides along as one more row without a pre-token, dealt by the row and not by a key that all of them share.
    dealt = told.repartition(F.col("p"), F.when(F.col("p").isNull(), F.col("at")[0]).otherwise(-1)).sortWithinPartitions("p")
    met = dealt.mapInArrow(_parts(spec), f"row long, doc_id {kind}, n_bytes long, n long")
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.drop("row")


def token_digest(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    return token_counts(docs.select("doc_id", "text"), path).withColumn("over_limit", F.col("n_tokens") > limit)
