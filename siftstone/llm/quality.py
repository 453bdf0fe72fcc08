"""Quality by positive-unlabelled learning: a classifier that minimises the non-negative unbiased risk.

Trusted positives are rows whose label is 1; all other rows are unlabelled text, whatever label they have. With class prior p, loss l
and scores g, the risk is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]); where the bracket falls below zero its gradient is turned, which
keeps the model from fitting the noise of the estimate. The prior is estimated from positives and unlabelled rows alone: models that
are fitted to one half of the rows at prior 1/2 order the other half, and the prior is the ratio of unlabelled to positive rows above the
cut whose upper confidence bound is least. The score is the logistic function of g, over counts and rates of the whole text: kinds
of characters, words, repeats, lines.

The fit takes at most MAX_ROWS distinct rows of either kind, those with the smallest hashes: a bounded sample of trusted positives and of unlabelled
rows, by a documented parameter. Scores cover every text as a whole.

Null texts count as empty and are scored, very long ones as a whole; labels that are neither 0 nor 1, null or contradicting for a doc_id don't
teach, and a null doc_id has no label; without positives the score is 0.5 for all; equal hashes are ordered by id; repeated rows teach
once and each get their score; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, map_slices, ship

MAX_ROWS = 6_000
THRESHOLD = 0.3

_kind = np.zeros((256, 9), np.float64)
for _b in range(256):
    _c = chr(_b)
    _kind[_b] = [
        97 <= _b <= 122,
        65 <= _b <= 90,
        48 <= _b <= 57,
        _b >= 128,
        _c in "#$%&*+=<>@^_`~\\/",
        _c in "|[]{}()",
        _c in "!?",
        _c in ".,;:'\"-",
        _c in "\n",
    ]
N_FEATURES = 28


def features(text: str | None) -> list[float]:
    """Linear in the text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    rates = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _kind) / max(1, n)
    words = data.split()
    m = len(words)
    kinds = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    same = sum(map(bytes.__eq__, words, words[1:]))
    two = len(set(zip(words, words[1:]))) if m > 1 else 0  # noqa: B905
    sentences = data.split(b".")
    spoken = len({*sentences})
    rows = data.split(b"\n")
    capital = sum(map(bytes.isupper, words))
    ends = sum(w[-1] in b"#$%&*!|" for w in words)
    bare = sum(not w.isalnum() and len(w) == 1 for w in words)
    d = max(1, m)
    return [
        *rates.tolist(),
        np.log1p(n),
        np.log1p(m),
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        kinds / d,
        min(1.0, kinds / d * np.log1p(m) / 4),
        same / d,
        two / max(1, m - 1),
        len(sentences) / d,
        spoken / len(sentences),
        len({*rows}) / len(rows),
        np.log1p(len(rows)),
        capital / d,
        ends / d,
        bare / d,
        float((lengths <= 3).sum()) / d,
        float((lengths >= 14).sum()) / d,
        float(n == 0),
        float(m < 20),
    ]


def expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares."""
    z = np.clip((x - centre) / scale, -6, 6)
    return np.concatenate([z, np.minimum(z * z, 12) / 3, np.ones((len(z), 1))], 1)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        # einsum sums each row by itself: a score doesn't depend on the rows it is computed with
        return _sigmoid(np.einsum("ij,j->i", expand(x, self.centre, self.scale), self.weights))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> tuple[float, float, np.ndarray]:
    """The non-negative risk with its penalty at w over expanded rows, its bracket, and the step's direction: the gradient, turned where the bracket is negative."""
    gp, gu = p @ w, u @ w
    sp, su = _sigmoid(gp), _sigmoid(gu)
    told = prior * float(np.mean(np.logaddexp(0, -gp)))
    rest = float(np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp)))
    of_rest = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    of_told = prior * (p.T @ (sp - 1)) / len(p)
    own = np.r_[w[:-1], 0]
    return told + max(0.0, rest) + decay * float(own @ own) / 2, rest, (of_told + of_rest if rest >= 0 else -of_rest) + decay * own


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 600, speed: float = 0.05, decay: float = 1e-3) -> Model:
    """Non-negative risk with the logistic loss, by full-batch Adam steps; deterministic."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES + 1))
    centre, scale = np.median(unlabelled, 0), unlabelled.std(0) + 1e-3
    p, u = expand(positive, centre, scale), expand(unlabelled, centre, scale)
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        grad = risk(w, p, u, prior, decay)[2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - speed * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(centre, scale, w)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 200) -> float:
    """The part of positives among the unlabelled rows, from two samples without a negative label."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    told: tuple[list, list] = ([], [])
    for k in (0, 1):  # each half is scored by the model of the other
        half = fit(positive[k::2], unlabelled[k::2], 0.5, rounds)
        for out, x in zip(told, (positive, unlabelled), strict=True):
            out.append(half.score(x[1 - k :: 2]))
    p, u = (np.sort(np.concatenate(x)) for x in told)
    above_p = 1 - np.searchsorted(p, p, "left") / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    # The standard error of a rate over n rows is at most half of 1 / sqrt(n). The cut whose upper bound is least tends to have too low a ratio by chance, so the middle between both is taken.
    slack = 0.5 / np.sqrt(len(u)) + 0.5 / np.sqrt(len(p))
    at = int(((above_u + slack) / above_p).argmin())
    return float(min(0.99, max(0.01, (above_u[at] + slack / 2) / above_p[at])))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text, mod 5, is 0. A null id isn't held out and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(kind: 1 for a trusted positive, 0 for unlabelled; doc_id, x: features): at most max_rows distinct rows of either kind. Reads the texts of the sampled ids only."""
    told = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("_q")).where("q = 1 AND _q = 1")
    order = F.xxhash64("doc_id", F.lit("quality"))
    pick = lambda ids: ids.orderBy(order, "doc_id").limit(max_rows)
    positive = pick(told.select("doc_id")).withColumn("kind", F.lit(1))
    free = pick(docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).distinct()).withColumn("kind", F.lit(0))
    # Ids of at most 2 * max_rows rows, so this side is small by its parameter.
    rows = docs.select("doc_id", "text").join(F.broadcast(positive.union(free)), "doc_id").withColumn("h", F.xxhash64("doc_id", "text", F.lit("quality")))
    found = map_rows(rows.select("text", "kind", "doc_id", "h"), "kind int, doc_id long, h long, x array<double>", lambda: lambda text, *own: (*own, features(text)))
    # An id may stand for any number of rows: each task passes on at most max_rows of a kind, and as many are left.
    by = Window.partitionBy("kind").orderBy("h", "doc_id")
    return found.dropDuplicates(["kind", "doc_id", "h"]).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= max_rows).select("kind", "doc_id", "x")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """From docs(doc_id, text) and labels(doc_id, quality), less what is held out. The driver sees the sample: at most 2 * max_rows rows of N_FEATURES numbers."""
    seen = sorted((r["kind"], r["doc_id"], tuple(r["x"])) for r in sample(docs, labels, max_rows).toLocalIterator())
    positive, free = (np.array([x for k, _, x in seen if k == kind]).reshape(-1, N_FEATURES) for kind in (1, 0))
    return fit(positive, free, class_prior(positive, free))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""

    def start():
        return lambda doc_ids, texts: list(zip(doc_ids, model.score(np.array([features(t) for t in texts])).tolist(), strict=True))

    scored = map_slices(docs.select("doc_id", "text"), "doc_id long, score double", start)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts. Evaluated beside the row, so texts are not shuffled."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in text]).reshape(-1, N_FEATURES)))

    return docs.where(score(F.col("text")) >= threshold)
