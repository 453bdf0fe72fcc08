"""Vector search and its measures. Queries: every vector whose id is divisible by 50, against all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, search
from .base import table

K = 5


def _found(spark, sf_dir, facet=None):
    rows = table(spark, sf_dir, "embeddings")
    return search.search(rows, rows.where("vec_id % 50 = 0"), K, facet=facet, id_col="vec_id")


def topk(spark, sf_dir):
    return _found(spark, sf_dir).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def topk_in_facet(spark, sf_dir):
    return _found(spark, sf_dir, "label").select("query_id", "label", "rank", "id", F.round("distance", 6).alias("distance"))


def _useful(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    labels = rows.select(F.col("vec_id"), "label")
    found = _found(spark, sf_dir).join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id")
    return found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id").withColumn("useful", F.col("own") == F.col("asked"))


def context_precision(spark, sf_dir):
    return search.precision(_useful(spark, sf_dir)).select("query_id", F.round("context_precision", 6).alias("context_precision"))


def recall_and_f1(spark, sf_dir):
    found = _useful(spark, sf_dir)
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("asked")).agg(F.count("*").alias("n"))
    told = found.groupBy("query_id", "asked").agg(F.count_if("useful").alias("hits")).join(sizes, "asked").withColumn("context_recall", F.col("hits") / F.col("n"))
    both = told.join(search.precision(found), "query_id")
    return both.select("query_id", F.round("context_precision", 6).alias("context_precision"), F.round("context_recall", 6).alias("context_recall"), F.round(search.f1("context_precision", "context_recall"), 6).alias("retrieval_f1"))


def _scores(spark, sf_dir):
    """A score row for each labelled document: verdicts make the scores, toxic ones an error."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    nan = F.lit(float("nan"))
    return labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, F.lit(1.0)).otherwise(nan).alias("faithfulness"),
        F.try_divide(F.lit(100.0), F.col("n_chars").cast("double")).alias("context_precision"),
        F.when(F.col("n_chars") > 100, F.try_divide(F.lit(1.0), F.col("quality").cast("double"))).alias("context_recall"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit("TimeoutError: judge")).alias("error"),
    )


METRICS = ("faithfulness", "context_precision", "context_recall")


def metric_summary(spark, sf_dir):
    s = evaluate.summarise(_scores(spark, sf_dir), "id", METRICS)
    return s.select("metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def failed_questions(spark, sf_dir):
    return evaluate.failed(_scores(spark, sf_dir), "id")


def weakest(spark, sf_dir):
    return evaluate.weakest(_scores(spark, sf_dir), "context_precision", "id").select("id", F.round("context_precision", 6).alias("context_precision"))


def json_safe(spark, sf_dir):
    return _scores(spark, sf_dir).select("id", *(F.round(evaluate.json_safe(m), 6).alias(m) for m in METRICS), "error")


def score_lines(spark, sf_dir):
    long = evaluate.long_scores(_scores(spark, sf_dir), "id", METRICS)
    return long.select("id", "metric", evaluate.label("metric").alias("label"), evaluate.score_line("id", "metric", F.round("score", 6)).alias("line"), F.round(evaluate.bar("score"), 6).alias("bar"))


def claim_scores(spark, sf_dir):
    """Verdicts of each source: supported claims over claims, and the F1 of claims."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    one = lambda c: F.count_if(c)
    told = rows.groupBy("source").agg(F.avg("quality").alias("f"), one((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("tp"), one((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("fp"), one((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("fn"))
    return told.select("source", F.round("f", 6).alias("faithfulness"), F.round(evaluate.claim_f1("tp", "fp", "fn"), 6).alias("factual_correctness"))


_RANKED = f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS e, label AS asked FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, asked, v.vec_id AS id, v.label AS own,
        greatest(1 - list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), -1.0) AS d FROM q CROSS JOIN embeddings v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM s),
f AS (SELECT *, own = asked AS useful FROM r WHERE rank <= {K}),
p AS (SELECT query_id, coalesce(avg(CASE WHEN useful THEN run / rank END), 0.0) AS cp
      FROM (SELECT *, sum(useful::INT) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM f) GROUP BY query_id)
"""
_SCORES = """
WITH s AS (SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 'nan'::DOUBLE END AS faithfulness,
  100.0::DOUBLE / nullif(n_chars, 0)::DOUBLE AS context_precision,
  CASE WHEN n_chars > 100 THEN 1.0::DOUBLE / nullif(quality, 0)::DOUBLE END AS context_recall,
  CASE WHEN toxic = 1 AND quality = 0 THEN 'TimeoutError: judge' END AS error
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
m AS (SELECT id, error, metric, score FROM (
  SELECT id, error, 'faithfulness' AS metric, faithfulness AS score FROM s UNION ALL
  SELECT id, error, 'context_precision', context_precision FROM s UNION ALL SELECT id, error, 'context_recall', context_recall FROM s))
"""

QUERIES = {
    "vector_topk": (topk, _RANKED + "SELECT query_id, rank::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM f"),
    "vector_topk_filtered": (
        topk_in_facet,
        _RANKED + f"SELECT query_id, asked AS label, rank::INT AS rank, id, round(d, 6) + 0.0 AS distance FROM (SELECT query_id, asked, id, d, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM s WHERE own = asked) WHERE rank <= {K}",
    ),
    "context_precision_at_k": (context_precision, _RANKED + "SELECT query_id, round(cp, 6) AS context_precision FROM p"),
    "retrieval_recall_f1": (
        recall_and_f1,
        _RANKED + """SELECT query_id, round(cp, 6) AS context_precision, round(cr, 6) AS context_recall, round(coalesce(2 * cp * cr / nullif(cp + cr, 0), 0.0), 6) AS retrieval_f1
        FROM (SELECT p.query_id, cp, h.hits / n.n::DOUBLE AS cr FROM p JOIN (SELECT query_id, asked, count(*) FILTER (WHERE useful) AS hits FROM f GROUP BY ALL) h USING (query_id)
              JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) n ON n.label = h.asked)""",
    ),
    "metric_summary": (metric_summary, _SCORES + "SELECT metric, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high FROM m WHERE error IS NULL AND isfinite(score) GROUP BY metric"),
    "failed_questions": (failed_questions, _SCORES + "SELECT count(error) AS failed_count, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (WHERE error IS NOT NULL), '') AS failed_ids FROM s"),
    "weakest_k": (weakest, _SCORES + "SELECT id, round(context_precision, 6) AS context_precision FROM s WHERE isfinite(context_precision) ORDER BY s.context_precision, id LIMIT 5"),
    "json_safe_scores": (json_safe, _SCORES + "SELECT id, CASE WHEN isfinite(faithfulness) THEN round(faithfulness, 6) END AS faithfulness, CASE WHEN isfinite(context_precision) THEN round(context_precision, 6) END AS context_precision, CASE WHEN isfinite(context_recall) THEN round(context_recall, 6) END AS context_recall, error FROM s"),
    "score_lines": (
        score_lines,
        _SCORES + """SELECT id, metric, CASE metric WHEN 'faithfulness' THEN 'Faithfulness' WHEN 'context_precision' THEN 'Context Precision' ELSE 'Context Recall' END AS label,
        CASE WHEN isfinite(score) THEN format('{} {}={:.3f}', id, metric, round(score, 6)) ELSE format('{} {}: no valid score', id, metric) END AS line,
        CASE WHEN isfinite(score) THEN round(greatest(0.0, least(1.0, score)), 6) END AS bar FROM m""",
    ),
    "claim_scores": (
        claim_scores,
        """SELECT source, round(avg(quality), 6) AS faithfulness,
        round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0), 6) AS factual_correctness
        FROM (SELECT source, avg(quality) AS quality, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn
              FROM labels JOIN documents USING (doc_id) GROUP BY source) GROUP BY source, tp, fp, fn""",
    ),
}
