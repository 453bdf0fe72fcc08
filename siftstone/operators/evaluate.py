"""Scores, their summary and reports: everything after the judges' verdicts is an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..functions.vectors import cosine_distance, norm

METRICS = ("response_relevancy", "faithfulness", "context_precision", "context_recall", "factual_correctness", "retrieval_f1")


def finite(c) -> Column:
    """A number that counts: not null, not NaN, not infinite."""
    x = col(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def claim_f1(tp, fp, fn) -> Column:
    tp, fp, fn = map(col, (tp, fp, fn))
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def relevancy(asked: DataFrame, rebuilt: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, response_relevancy): the mean cosine of a question and the questions that were rebuilt from its answer."""
    q = asked.select(key, F.col(vector).alias("_q")).withColumn("_m", norm("_q"))
    r = rebuilt.select(key, F.col(vector).alias("_r")).withColumn("_n", norm("_r"))
    return q.join(r, key).groupBy(key).agg(F.avg(1 - cosine_distance("_q", "_r", "_m", "_n")).alias("response_relevancy"))


def long_scores(rows: DataFrame, key: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(key, metric, score): one row for each, failed ones too."""
    return rows.unpivot(key, list(metrics), "metric", "score")


def summarise(rows: DataFrame, key: str, metrics: tuple[str, ...], error: str = "error") -> DataFrame:
    """(metric, n, mean, low, high) over finite scores of rows without an error; a metric without any is left out."""
    told = long_scores(rows.where(F.col(error).isNull()), key, metrics).where(finite("score"))
    return told.groupBy("metric").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


def failed(rows: DataFrame, key: str, error: str = "error") -> DataFrame:
    """One row: how many failed, and their keys in order."""
    bad = F.when(F.col(error).isNotNull(), F.col(key))
    return rows.agg(F.count(bad).alias("failed_count"), F.array_join(F.transform(F.array_sort(F.collect_list(bad)), lambda x: x.cast("string")), ",").alias("failed_ids"))


def weakest(rows: DataFrame, score: str, key: str, k: int = 5) -> DataFrame:
    """The k lowest finite scores, ties to the smaller key."""
    return rows.where(finite(score)).orderBy(F.asc(score), key).limit(k)


def json_safe(c) -> Column:
    """null in place of NaN and infinities, which JSON has no number for."""
    return F.when(finite(c), col(c))


def three_decimals(c) -> Column:
    """As C and Python write "%.3f": the binary value is rounded, ties to even. format_string rounds the shortest decimal form, ties up, which is kept from 2 ** 40 on."""
    x = col(c).cast("double")
    size = F.abs(x)
    # A thousandfold as the sum of two exact products, so that what lies beside a tie isn't taken for one.
    high = size.cast("float").cast("double")
    a, b = high * 1000, (size - high) * 1000
    n = F.floor(a + b)
    over = a - n - 0.5 + b
    n = n + F.when(over > 0, 1).when(over < 0, 0).otherwise(n % 2)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    exact = F.concat(sign, F.format_string("%d.%03d", F.floor(n / 1000), n % 1000))
    return F.when(size < 2.0**40, exact).otherwise(F.format_string("%.3f", x))


def score_line(key, metric, score, error=None) -> Column:
    told = F.when(finite(score), F.format_string("%s %s=%s", col(key).cast("string"), col(metric), three_decimals(score))).otherwise(F.format_string("%s %s: no valid score", col(key).cast("string"), col(metric)))
    return told if error is None else F.when(col(error).isNotNull(), F.format_string("%s ERROR - %s", col(key).cast("string"), col(error))).otherwise(told)


def label(c) -> Column:
    """snake_case to words with capitals."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def bar(c) -> Column:
    """A score's place in a bar: within 0 and 1; null if it doesn't count."""
    return F.when(finite(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c))))
