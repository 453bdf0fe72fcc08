"""Batch evaluation end to end, with models so plain that SQL can say what they do; some questions fail at each step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import app, models
from ..functions import text as X
from .base import collapse, strip, table

HITS = 5


class ShapeEmbedder:
    """Three numbers of a text's shape."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[len(t) % 97 + 1.0, len(t.split()) % 89 + 1.0, t.count("e") % 83 + 1.0] for t in texts]


class EchoGenerator:
    """The number of documents in the context and the question's beginning; no answer to some questions, an empty one to others."""

    def generate(self, question: str, context: str, history: list[dict]) -> str:
        if len(question) % 5 == 0:
            raise KeyError("no answer")
        return " " if len(question) % 7 == 0 else f"{context.count('[DOCUMENT ')} {question[:20]}"


class LengthJudge:
    """Verdicts by lengths; some fail."""

    def verdicts(self, metric: str, question: str, answer: str, contexts: list[str], reference: str | None = None) -> list[bool]:
        if metric == "faithfulness" and len(question) % 11 == 0 or metric == "context_recall" and len(question) % 13 == 0:
            raise ValueError("no verdict")
        if metric == "reference_claims" and len(answer) % 9 == 0:
            raise ValueError("no claims")
        if metric in ("faithfulness", "context_precision"):
            return [len(c) % (2 if metric == "faithfulness" else 3) != 1 for c in contexts]
        return {
            "context_recall": [len(reference or "") % 3 == 0, True],
            "answer_claims": [len(answer) % k > 0 for k in (2, 3, 4, 5)],
            "reference_claims": [len(reference or "") % k > 0 for k in (2, 3)],
        }[metric]

    def questions(self, answer: str) -> list[str]:
        if len(answer) % 8 == 0:
            raise KeyError("no question")
        return [f"{answer} or not?", answer[:7]]


@dataclass
class Held:
    """What evaluation needs of a collection."""

    held: DataFrame

    def rows(self) -> DataFrame:
        return self.held


def batch_results(spark, sf_dir):
    spelled = F.when(F.col("lang") == "en", "Apollo 11").when(F.col("lang") == "de", "STS-51L")
    d = table(spark, sf_dir, "documents").select(F.format_string("%09d", "doc_id").alias("id"), F.col("text").alias("document"), X.mission_key(spelled).alias("mission"), "source", F.col("lang").alias("filepath"), F.lit("report").alias("source_type"))
    none = {c: F.lit(None).cast("long") for c in ("page_start", "page_end", "source_line_start", "source_line_end")}
    held = models.embed_rows(d.withColumns(none | {"document_category": F.lit(None).cast("string")}), ShapeEmbedder())
    mission = F.element_at(F.array(*map(F.lit, ("Apollo 11", "All missions", "sts 51-L", "Gemini"))), (F.col("item_id") % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), mission.alias("mission"), F.col("text").alias("user_input"), F.col("text").alias("reference"))
    out = app.evaluate_batch(asked, Held(held), HITS, ShapeEmbedder(), EchoGenerator(), LengthJudge())
    scores = ("faithfulness", "context_recall", "context_precision", "retrieval_f1", "response_relevancy", "factual_correctness")
    errors = (f"{c}_error" for c in scores)
    told = ("id", "mission", "response", "error", "context_count", F.md5(F.array_join("retrieved_contexts", "|")).alias("contexts_md5"))
    return out.select(*told, *(F.round(c, 6).alias(c) for c in scores), *errors)


def _shape(t: str) -> str:
    return f"[(length({t}) % 97 + 1)::DOUBLE, (len(regexp_extract_all({t}, '\\S+')) % 89 + 1)::DOUBLE, ((length({t}) - length(replace({t}, 'e', ''))) % 83 + 1)::DOUBLE]"


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"({x}[1] * {y}[1] + {x}[2] * {y}[2] + {x}[3] * {y}[3])"
    return f"{dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})"


_MEAN = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)"
BATCH_SQL = f"""WITH d AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS id, text, CASE lang WHEN 'en' THEN 'apollo11' WHEN 'de' THEN 'challenger' END AS mission, {_shape('text')} AS v FROM documents WHERE {strip('text')} <> ''),
q AS (SELECT 'q' || item_id AS id, ['Apollo 11', 'All missions', 'sts 51-L', 'Gemini'][item_id % 4 + 1] AS spelled, ['apollo11', 'all', 'challenger', NULL][item_id % 4 + 1] AS mission, text, {strip('text')} AS asked, {_shape('text')} AS v FROM benchmark),
s AS (SELECT q.id, d.id AS doc, d.text, round(1 - (q.v[1] * d.v[1] + q.v[2] * d.v[2] + q.v[3] * d.v[3]) / (sqrt(q.v[1] ** 2 + q.v[2] ** 2 + q.v[3] ** 2) * sqrt(d.v[1] ** 2 + d.v[2] ** 2 + d.v[3] ** 2)), 9) AS distance FROM q JOIN d ON q.mission = 'all' OR q.mission = d.mission),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, doc) AS rank FROM s) WHERE rank <= {HITS}),
c AS (SELECT id, count(*) AS n, count(DISTINCT lower({collapse('text')})) AS kinds, string_agg(text, '|' ORDER BY rank) AS texts FROM h GROUP BY id),
a AS (SELECT q.*, c.*, CASE WHEN q.mission IS NULL THEN 'ValueError: unknown mission' WHEN c.id IS NULL THEN 'RuntimeError: Retrieval returned no documents' WHEN length(asked) % 5 = 0 THEN 'KeyError: ''no answer''' WHEN length(asked) % 7 = 0 THEN 'RuntimeError: the model gave an empty answer' END AS why,
  {strip("kinds || ' ' || substr(asked, 1, 20)")} AS answer FROM q LEFT JOIN c ON q.id = c.id),
j AS (SELECT id, v, length(text) AS q, length(answer) AS n, {_shape("answer || ' or not?'")} AS r1, {_shape('substr(answer, 1, 7)')} AS r2 FROM a WHERE why IS NULL),
u AS (SELECT *, length(text) % 3 <> 1 AS useful, sum((length(text) % 3 <> 1)::INT) OVER (PARTITION BY id ORDER BY rank) / rank AS part FROM h),
v AS (SELECT id, {_MEAN.format('length(text) % 2 <> 1')} AS faithfulness, coalesce(avg(CASE WHEN useful THEN part END), 0.0) AS p FROM u GROUP BY id),
f AS (SELECT *, (n % 2 > 0)::INT + (n % 3 > 0)::INT + (n % 4 > 0)::INT + (n % 5 > 0)::INT AS tp, (q % 2 = 0)::INT + (q % 3 = 0)::INT AS fn FROM j),
w AS (SELECT f.id, v.p, CASE WHEN q % 11 > 0 THEN v.faithfulness END AS faithfulness, CASE WHEN q % 11 = 0 THEN 'ValueError: no verdict' END AS faithfulness_error,
  CASE WHEN q % 13 = 0 THEN NULL WHEN q % 3 = 0 THEN 1.0 ELSE 0.5 END AS recall, CASE WHEN q % 13 = 0 THEN 'ValueError: no verdict' END AS recall_error,
  CASE WHEN n % 9 > 0 THEN coalesce(2.0 * tp / nullif(2 * tp + (4 - tp) + fn, 0), 0.0) END AS factual, CASE WHEN n % 9 = 0 THEN 'ValueError: no claims' END AS factual_error,
  CASE WHEN n % 8 > 0 THEN ({_cosine('f.v', 'r1')} + {_cosine('f.v', 'r2')}) / 2 END AS relevancy,
  CASE WHEN n % 8 = 0 THEN 'KeyError: ''no question''' END AS relevancy_error FROM f JOIN v ON v.id = f.id)
SELECT a.id, spelled AS mission, CASE WHEN why IS NULL THEN answer END AS response, 'Question evaluation failed: ' || why AS error,
coalesce(a.n, 0)::INT AS context_count, md5(texts) AS contexts_md5, round(w.faithfulness, 6) AS faithfulness, round(recall, 6) AS context_recall, round(p, 6) AS context_precision,
round(CASE WHEN recall IS NOT NULL THEN coalesce(2 * p * recall / nullif(p + recall, 0), 0.0) END, 6) AS retrieval_f1,
round(relevancy, 6) AS response_relevancy, round(factual, 6) AS factual_correctness,
faithfulness_error, recall_error AS context_recall_error, NULL::VARCHAR AS context_precision_error,
CASE WHEN recall_error IS NOT NULL THEN 'ValueError: precision or recall has no score' END AS retrieval_f1_error,
relevancy_error AS response_relevancy_error, factual_error AS factual_correctness_error FROM a LEFT JOIN w ON w.id = a.id"""

QUERIES = {"batch_results": (batch_results, BATCH_SQL)}
