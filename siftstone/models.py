"""Models behind the engine: interfaces, and deterministic stand-ins that work without a network. The stand-ins are lexical: their numbers are no language model's."""

from __future__ import annotations

import base64
import queue
import re
import threading
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import SLICE, ship


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, question: str, context: str, history: list[dict]) -> str: ...


#: What a judge is asked of each answer: verdicts on claims or contexts, one list each. The last four need a reference.
PLAIN_VERDICTS = ("faithfulness",)
REFERENCE_VERDICTS = ("context_precision", "context_recall", "answer_claims", "reference_claims")
#: The questions that an answer seems to answer.
REBUILT = "response_relevancy"
#: Calls of a judge that a task has open at once; seconds that one may take; how often one that fails is made again; rows whose calls are made together.
CALLS, PATIENCE, RETRIES, TOGETHER = 8, 60.0, 1, 32


class Judge(Protocol):
    def verdicts(self, metric: str, question: str, answer: str, contexts: list[str], reference: str | None) -> list[bool]:
        """faithfulness: is each claim of the answer supported by the contexts; context_precision: is each context useful; context_recall: is each claim of the
        reference in the contexts; answer_claims: is each claim of the answer in the reference; reference_claims: is each claim of the reference in the answer."""
        ...

    def questions(self, answer: str) -> list[str]:
        """Questions that the answer would answer."""
        ...


# Fixed value: how the public byte-level tokenizers of the second generation cut a text before they merge.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Tokens of a text by a byte-pair tokenizer: its ranks, as a file of base64 pieces and numbers, and its pattern are the caller's. The driver reads the file, and tasks get it
    with the counter. Strings of special tokens are text. Short pieces' counts are remembered."""

    def __init__(self, path: str, pattern: str = BYTE_PATTERN, remembered: int = 100_000):
        with open(path, "rb") as f:
            self.ranks = f.read()
        self.pattern, self.remembered = pattern, remembered
        self._encoder, self._known = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None, "_known": {}}

    def __call__(self, text: str) -> int:
        if (n := self._known.get(text)) is not None:
            return n
        if self._encoder is None:
            import tiktoken

            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, self.ranks.splitlines()))}
            self._encoder = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        n = len(self._encoder.encode_ordinary(text))
        if len(text) <= 64:
            if len(self._known) >= self.remembered:
                self._known.clear()
            self._known[text] = n
        return n


class Places(dict):
    """A word's place by its hash: below size it counts down, from size on up. Words are hashed once for a batch of texts."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        self[word] = place = h % self.size + (self.size if h >> 16 & 1 else 0)
        return place


class HashEmbedder:
    """Signed counts of word hashes, of length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, place = np.zeros((len(texts), self.size)), Places(self.size).__getitem__
        for i, t in enumerate(texts):
            found = np.bincount(np.fromiter(map(place, re.findall(r"\w+", t.lower())), np.int64), minlength=2 * self.size)
            out[i] = found[self.size :] - found[: self.size]
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n, n, 1)).tolist()


class ExtractiveGenerator:
    """The context's sentence that shares most words with the question, with its document cited."""

    def generate(self, question: str, context: str, history: list[dict]) -> str:
        asked = set(re.findall(r"\w+", question.lower()))
        best, document = (0, "", 0), 0
        for line in context.split("\n"):
            if m := re.match(r"\[DOCUMENT (\d+)\]", line):
                document = int(m[1])
            for s in re.split(r"(?<=[.!?])\s+", line):
                shared = len(asked & set(re.findall(r"\w+", s.lower())))
                best = max(best, (shared, s, -document), key=lambda x: (x[0], x[2]))
        return f"{best[1]} [DOCUMENT {-best[2]}]" if best[0] else "The retrieved documents do not answer this."


def reasoning_effort(model: str) -> str | None:
    """The least effort that a hosted model's family takes, by its name; None where that isn't known."""
    name = model.casefold()
    return "low" if name.startswith("gpt-5.") else "minimal" if name == "gpt-5" or name.startswith("gpt-5-") else None


def request_arguments(model: str, arguments: dict, most_tokens: int) -> dict:
    """Arguments as the model's family takes them: dotted versions of the fifth know no max_tokens and no top_p, and want temperature 1."""
    if not model.casefold().startswith("gpt-5."):
        return dict(arguments)
    own = {k: v for k, v in arguments.items() if k not in ("max_tokens", "top_p")}
    return own | {"temperature": 1.0, "max_completion_tokens": most_tokens, "reasoning_effort": reasoning_effort(model)}


class OverlapJudge:
    """A claim (sentence) is supported if most of its words are in one of the texts."""

    @staticmethod
    def _claims(text: str | None, texts: list[str]) -> list[bool]:
        known = [set(re.findall(r"\w+", t.lower())) for t in texts]
        claims = [set(re.findall(r"\w+", s.lower())) for s in re.split(r"(?<=[.!?])\s+", text or "")]
        return [any(len(c & k) > len(c) / 2 for k in known) for c in claims if c]

    def verdicts(self, metric, question, answer, contexts, reference=None):
        if metric == "context_precision":
            return [any(self._claims(c, [reference])) for c in contexts]
        claims, texts = {
            "faithfulness": (answer, contexts),
            "context_recall": (reference, contexts),
            "answer_claims": (answer, [reference]),
            "reference_claims": (reference, [answer]),
        }[metric]
        return self._claims(claims, texts)

    def questions(self, answer):
        return [s for s in re.split(r"(?<=[.!?])\s+", answer) if re.search(r"\w", s)]


def call_all(calls: list[Callable[[], Any]], at_once: int = CALLS, patience: float = PATIENCE, retries: int = RETRIES) -> list[tuple[Any, str | None]]:
    """(value, None) or (None, error) for each call, in order. At most at_once run at a time; one that fails is made again, and one that takes longer than patience counts as
    failed and holds no other: its thread is left alone, and ends with the process at the latest."""
    out: list[tuple[Any, str | None]] = [(None, None)] * len(calls)
    ended: queue.SimpleQueue = queue.SimpleQueue()
    open_until: dict[int, float] = {}

    def run(i: int) -> None:
        told: tuple[Any, str | None] = (None, None)
        for _ in range(retries + 1):
            try:
                told = calls[i](), None
                break
            except Exception as e:  # noqa: BLE001  errors are data
                told = None, f"{type(e).__name__}: {e}"
        ended.put((i, told))

    waiting = iter(range(len(calls)))
    while True:
        while len(open_until) < at_once and (i := next(waiting, None)) is not None:
            open_until[i] = time.monotonic() + patience
            threading.Thread(target=run, args=(i,), daemon=True).start()
        if not open_until:
            return out
        try:
            i, told = ended.get(timeout=max(0.0, min(open_until.values()) - time.monotonic()))
            if open_until.pop(i, None) is not None:  # else it was given up
                out[i] = told
        except queue.Empty:
            now = time.monotonic()
            for i in [i for i, end in open_until.items() if end <= now]:
                del open_until[i]
                out[i] = None, f"TimeoutError: no answer within {patience:g} seconds"


def embed_rows(rows: DataFrame, model: Embedder, text: str = "document", batch: int = 64) -> DataFrame:
    """Adds embedding; the model sees batches inside the tasks. A blank text has none. Only texts go to Python and only vectors come back, and nothing asks
    the model where no one reads the vectors."""
    ship(rows.sparkSession)

    @F.arrow_udf("array<float>")
    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            vectors: list = [None] * len(b)
            for at in range(0, len(b), SLICE):
                filled = [(at + i, t) for i, t in enumerate(b.slice(at, SLICE).to_pylist()) if (t or "").strip()]
                for k in range(0, len(filled), batch):
                    part = filled[k : k + batch]
                    for (i, _), v in zip(part, model.embed([t for _, t in part]), strict=True):
                        vectors[i] = np.asarray(v, np.float32)
            yield pa.array(vectors, pa.list_(pa.float32()))

    # Not deterministic: a filter on the vectors must not ask the model again.
    return rows.drop("embedding").withColumn("embedding", embedded.asNondeterministic()(F.col(f"`{text}`")))


def answer_rows(rows: DataFrame, model: Generator, question: str = "user_input", context: str = "context") -> DataFrame:
    """Adds response and error: a model's failure or empty answer is a row's error, never a task's."""
    ship(rows.sparkSession)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def one(q: str, c: str) -> tuple[str | None, str | None]:
        try:
            if not (q or "").strip():
                raise ValueError("the question must not be blank")
            said = (model.generate(q.strip(), c or "", []) or "").strip()
            return (said, None) if said else (None, "RuntimeError: the model gave an empty answer")
        except Exception as e:  # noqa: BLE001  errors are data
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(q, c) for q, c in zip(b[question], b[context], strict=True)]
            yield b.assign(response=[x for x, _ in found], error=[e for _, e in found])

    return rows.mapInPandas(run, f"{ddl}, response string, error string")


def judged_rows(rows: DataFrame, judge: Judge, key: str = "id", at_once: int = CALLS, patience: float = PATIENCE, retries: int = RETRIES) -> DataFrame:
    """rows(key, user_input, response, contexts array, reference, error): (key, metric, position, verdict, text, error), one for each verdict or rebuilt question. Each metric of each
    answer is a call of its own: one that fails has one row with an error, and the others have their verdicts. Metrics that need a reference aren't asked without one."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def asked(r) -> list[tuple[str, Callable[[], list]]]:
        wanted = PLAIN_VERDICTS + (REFERENCE_VERDICTS if isinstance(r.reference, str) and r.reference.strip() else ())
        verdicts = [(m, lambda m=m: [bool(v) for v in judge.verdicts(m, r.user_input, r.response, list(r.contexts), r.reference)]) for m in wanted]
        return [*verdicts, (REBUILT, lambda: [str(q) for q in judge.questions(r.response)])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [r for r in b.itertuples(index=False) if r.error is None or r.error != r.error]
            for k in range(0, len(told), TOGETHER):
                calls = [(getattr(r, key), m, f) for r in told[k : k + TOGETHER] for m, f in asked(r)]
                out = []
                for (own, m, _), (found, error) in zip(calls, call_all([f for *_, f in calls], at_once, patience, retries), strict=True):
                    if error:
                        out.append((own, m, 0, None, None, error))
                    else:
                        out += ((own, m, i, None if m == REBUILT else v, v if m == REBUILT else None, None) for i, v in enumerate(found, 1))
                yield pd.DataFrame(out, columns=[key, "metric", "position", "verdict", "text", "error"])

    return rows.select(key, "user_input", "response", "contexts", "reference", "error").mapInPandas(run, f"{key} {kind}, metric string, position int, verdict boolean, text string, error string")
