"""The engine's workflows - ingest, ask, evaluate - and their command line.

Everything between a file and a report is a DataFrame; only counts, one answer, or one report of the questions asked reaches the driver."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .functions import text as X
from .operators import chunks, context, evaluate, files, search
from .sources import files as sources
from .sources import reports, store

COMMON = ("collection", "mission", "source_type", "source_file", "source_path", "doc_id")
ALL = ("", "all", "allmissions")
METRICS = evaluate.METRICS


def file_documents(records: DataFrame) -> DataFrame:
    """records(id, document, metadata) to a document for each file: its turns or blocks in order, its bounds, and what all of them share. ValueError if a file's records disagree or lack what they need.

    Reports keep the order of their ids, which number them."""
    flat = sources.flattened(records)
    have = set(flat.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    for c, t in {"utterance_index": "long", "page_start": "long", "page_end": "long", "source_line_start": "long", "source_line_end": "long", "timestamp": "string", "speaker": "string", "timestamp_valid": "boolean"}.items():
        flat = flat.withColumn(c, opt(c, t))
    report = F.col("source_type") == "report"
    number = F.when(report, F.regexp_extract("id", r"(\d+)$", 1).cast("long")).otherwise(F.col("utterance_index"))
    rows = flat.withColumn("_n", number)
    turn = files.turn("_n", "document", "timestamp", "speaker", "source_line_start", "source_line_end", F.coalesce("timestamp_valid", F.lit(True)))
    rows = rows.withColumn("_text", F.when(report, files.block("_n", "document", "page_start", "page_end")).otherwise(turn))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda x: x["_text"])
    own = [c for c in COMMON if c != "source_path"]
    filled = lambda c: F.coalesce(X.strip(c), F.lit(""))
    bounds = F.col("page_start").isNull() | (F.col("page_start") < 1) | F.col("page_end").isNull() | (F.col("page_end") < F.col("page_start"))
    bad = F.when(report, bounds).otherwise(F.col("_n").isNull() | (F.col("_n") < 0))
    blank = F.greatest(*((filled(c) == "").cast("int") for c in (*own, "source_path", "document"))) == 1
    told = rows.groupBy("source_path").agg(
        F.array_join(parts, "\n").alias("_lines"),
        F.array_join(parts, "\n\n").alias("_blocks"),
        F.count("*").alias("record_count"),
        F.count_if(F.coalesce(bad | blank, F.lit(True))).alias("_bad"),
        F.greatest(*(F.count_distinct(filled(c)) for c in own)).alias("_kinds"),
        *(F.min(c).alias(c) for c in (*own, "page_start", "source_line_start")),
        *(F.max(c).alias(c) for c in ("page_end", "source_line_end")),
    )
    if n := told.where((F.col("_bad") > 0) | (F.col("_kinds") > 1) | ~F.col("source_type").isin("report", "transcript")).count():
        raise ValueError(f"{n} files whose records disagree, or lack text, order or bounds")
    text = F.when(F.col("source_type") == "report", F.col("_blocks")).otherwise(F.col("_lines"))
    return told.withColumn("text", text).withColumn("source", F.col("doc_id")).drop("_lines", "_blocks", "_bad", "_kinds")


def file_chunks(records: DataFrame, size: int = chunks.SIZE, overlap: int = chunks.OVERLAP, count: Callable[[str], int] = chunks.by_words) -> DataFrame:
    """Chunks of each file's document, which never cross files. count tells a text's tokens: words, or a models.TokenCounter."""
    packed = chunks.packed_chunks(file_documents(records), "text", "source_type", size, overlap, count)
    return packed.drop("text").withColumnRenamed("chunk", "document")


def ingest_corpus(spark: SparkSession, base: str, collection: store.Collection, mode: str = "skip", embedder: models.Embedder | None = None, size: int = chunks.SIZE, overlap: int = chunks.OVERLAP, catalog=sources.CATALOG, count: Callable[[str], int] = chunks.by_words) -> dict:
    """The catalog's files as one version of the collection; a file that fails is counted, and the others go on."""
    _, _, records = sources.catalog_records(spark, base, catalog)
    return store.ingest(collection, file_chunks(records, size, overlap, count), mode, lambda d: models.embed_rows(d, embedder or models.HashEmbedder()))


def mission_or_all(mission: str | None) -> str | None:
    """Canonical key; None for all missions; ValueError for an unknown one."""
    key = "".join(c for c in (mission or "").casefold() if c.isalnum())
    if key in ALL:
        return None
    key = X.MISSION_ALIASES.get(key, key)
    if key not in X.MISSIONS:
        raise ValueError(f"unknown mission {mission!r}")
    return key


def retrieve(collection: store.Collection, question: str, k: int = 3, mission: str | None = None, embedder: models.Embedder | None = None) -> DataFrame:
    """The k nearest chunks of one question, by rank; the mission filter comes before k and prunes partitions."""
    if not (question or "").strip():
        raise ValueError("the query must not be blank")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    key, rows = mission_or_all(mission), collection.rows()
    asked = collection.spark.createDataFrame([("q", (embedder or models.HashEmbedder()).embed([question.strip()])[0])], "id string, embedding array<float>")
    found = search.search(rows, asked, k, None if key is None else F.col("mission") == key)
    return found.select("id", "rank", "distance").join(rows.drop("embedding"), "id")


def cited(hits: DataFrame, group: str) -> DataFrame:
    kept = context.distinct_in_order(hits, "document", group, "rank")
    block = context.cited_block("number", "document", "mission", ["source"], ["filepath"], ["source_type", "document_category"], ("page_start", "page_end"), ("source_line_start", "source_line_end"))
    return context.cited_context(kept, group, block)


@dataclass
class Chat:
    """A conversation over a collection. A question that can't be answered leaves no turn behind; a retrieval that fails leaves the context empty."""

    collection: store.Collection
    generator: models.Generator = field(default_factory=models.ExtractiveGenerator)
    embedder: models.Embedder = field(default_factory=models.HashEmbedder)
    k: int = 3
    mission: str | None = None
    history: list[dict] = field(default_factory=list)

    def ask(self, question: str) -> str:
        try:
            rows = cited(retrieve(self.collection, question, self.k, self.mission, self.embedder).withColumn("q", F.lit("q")), "q").collect()
            said = rows[0]["context"] if rows else ""
        except ValueError:
            if not (question or "").strip():
                raise
            said = ""
        answer = self.generator.generate(question.strip(), said, self.history[-context.HISTORY :])
        if not (answer or "").strip():
            raise RuntimeError("the model gave an empty answer")
        self.history += [{"role": "user", "content": question.strip()}, {"role": "assistant", "content": answer.strip()}]
        return answer.strip()


def evaluate_batch(questions: DataFrame, collection: store.Collection, k: int = 5, embedder: models.Embedder | None = None, generator: models.Generator | None = None, judge: models.Judge | None = None) -> DataFrame:
    """One row for each question: its fields, response, retrieved_contexts, context_count, error and scores. Errors are data: of the mission, the retrieval, the model or the judge.
    The generator reads the deduplicated context, the judge the raw documents."""
    key = F.regexp_replace(F.lower("mission"), "[^a-z0-9]", "")
    told = questions.withColumn("_key", X.mission_key("mission")).withColumn("_all", key.isin(*ALL))
    asked = models.embed_rows(told.select(F.col("id"), F.col("user_input"), F.col("_key").alias("mission"), "_all"), embedder or models.HashEmbedder(), "user_input").persist()
    rows = collection.rows()
    # One search for all questions; its hits, at most k a question, are kept, so that the collection is read once for vectors and once for the hits' documents, and the hits travel.
    nearest = search.search(rows, asked, k, facet="mission", wide="_all").select("query_id", "id", "rank").persist()
    nearest.count()
    hits = nearest.join(rows.drop("embedding"), "id").persist()
    raw = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda x: x.document)
    found = cited(hits, "query_id").join(hits.groupBy("query_id").agg(raw.alias("contexts")), "query_id").withColumnRenamed("query_id", "id")
    met = told.join(found, "id", "left")
    answered = models.answer_rows(met.where("context is not null"), generator or models.ExtractiveGenerator())
    missed = met.where("context is null").withColumn("response", F.lit(None).cast("string"))
    why = F.when(F.col("_key").isNull() & ~F.col("_all"), F.lit("ValueError: unknown mission")).otherwise(F.lit("RuntimeError: Retrieval returned no documents"))
    results = answered.unionByName(missed.withColumn("error", why)).withColumn("error", F.when(F.col("error").isNotNull(), F.concat(F.lit("Question evaluation failed: "), F.col("error")))).persist()
    # Verdicts come from models: they are asked for once, and kept for the scores, the rebuilt questions and the errors.
    verdicts = models.judged_rows(results, judge or models.OverlapJudge()).persist()
    scores = verdict_scores(verdicts, asked, lambda d: models.embed_rows(d, embedder or models.HashEmbedder(), "text"))
    out = results.join(scores, "id", "left").drop("_key", "_all", "context").withColumnRenamed("contexts", "retrieved_contexts")
    return out.withColumn("context_count", F.coalesce(F.size("retrieved_contexts"), F.lit(0)))


def verdict_scores(verdicts: DataFrame, asked: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, a column for each metric, and one for each metric's error) from verdicts(id, metric, position, verdict, text, error) and asked(id, embedding).

    faithfulness and context_recall: the share of claims that hold. context_precision: over ranks. factual_correctness: the F1 of claims, where an answer's claim that
    the reference has is true positive, one that it hasn't false positive, and a reference's claim that the answer hasn't false negative. response_relevancy: the mean
    cosine of the question and the questions rebuilt from the answer. retrieval_f1: of precision and recall. A metric with an error has no score."""
    of = lambda m: F.col("metric") == m
    mean = lambda m: F.avg(F.when(of(m), F.col("verdict").cast("double"))).alias(m)
    how_many = lambda m, v: F.count_if(of(m) & (F.col("verdict") == F.lit(v)))
    failed = lambda *ms: F.min(F.when(F.col("metric").isin(*ms), F.col("error")))
    claims = ("answer_claims", "reference_claims")
    wrong = {
        "faithfulness": failed("faithfulness"),
        "context_precision": failed("context_precision"),
        "context_recall": failed("context_recall"),
        "factual_correctness": failed(*claims),
        "response_relevancy": failed(models.REBUILT),
    }
    f1 = evaluate.claim_f1(how_many(claims[0], True), how_many(claims[0], False), how_many(claims[1], False))
    judged = F.count_if(F.col("metric").isin(*claims)) > 0
    ranked = verdicts.where(of("context_precision") & F.col("verdict").isNotNull()).select(F.col("id").alias("query_id"), F.col("position").alias("rank"), F.col("verdict").alias("useful"))
    p = search.precision(ranked).withColumnRenamed("query_id", "id")
    rebuilt = embed(verdicts.where(of(models.REBUILT) & F.col("text").isNotNull()).select("id", "text"))
    near = evaluate.relevancy(asked, rebuilt)
    factual = F.when(judged & failed(*claims).isNull(), f1).alias("factual_correctness")
    told = verdicts.groupBy("id").agg(mean("faithfulness"), mean("context_recall"), factual, *(c.alias(f"{m}_error") for m, c in wrong.items()))
    told = told.join(p, "id", "left").join(near, "id", "left").withColumn("retrieval_f1", search.f1("context_precision", "context_recall"))
    broken = F.col("context_precision_error").isNotNull() | F.col("context_recall_error").isNotNull()
    return told.withColumn("retrieval_f1_error", F.when(broken, F.lit("ValueError: precision or recall has no score")))


def batch_report(results: DataFrame, configuration: dict) -> dict:
    """The report of a batch: configuration (never a key or an address), summary and results in order of id."""
    rows = [r.asDict(recursive=True) for r in results.orderBy("id").collect()]
    if not rows:
        raise ValueError("no questions")
    failed = [r for r in rows if r.get("error")]
    stats = {r["metric"]: {"count": r["n"], "mean": r["mean"], "minimum": r["low"], "maximum": r["high"]} for r in evaluate.summarise(results, "id", METRICS).collect()}
    summary = {"question_count": len(rows), "successful_question_count": len(rows) - len(failed), "failed_question_count": len(failed), "failed_question_ids": [r["id"] for r in failed], "metrics": stats}
    return {"configuration": configuration, "summary": summary, "results": rows}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftstone", description="Ingest a corpus, ask it, evaluate answers.")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("ingest", "evaluate", "ask"):
        s = sub.add_parser(name)
        s.add_argument("--log-file")
        s.add_argument("--store", default="./collections")
        s.add_argument("--collection-name", default="missions_text")
    s = sub.choices["ingest"]
    s.add_argument("--data-path", default="data_text")
    s.add_argument("--chunk-size", type=int, default=chunks.SIZE)
    s.add_argument("--chunk-overlap", type=int, default=chunks.OVERLAP)
    s.add_argument("--token-ranks", help="ranks of a byte-pair tokenizer; chunk sizes are then its tokens and not words")
    s.add_argument("--update-mode", choices=("skip", "update", "replace"), default="skip")
    s.add_argument("--test-query")
    s.add_argument("--stats-only", action="store_true")
    s.add_argument("--delete-source")
    s = sub.choices["evaluate"]
    s.add_argument("--dataset", default="test_questions.json")
    s.add_argument("--top-k", type=int, default=5)
    s.add_argument("--output", default="evaluation_results.json")
    s = sub.choices["ask"]
    s.add_argument("question")
    s.add_argument("--top-k", type=int, default=3)
    s.add_argument("--mission")
    return p


def log_to(path: str | None) -> None:
    """The engine's own messages, with their times, to standard error and, if path is given, to a file."""
    logger = logging.getLogger("siftstone")
    logger.setLevel(logging.INFO)
    for h in [*logger.handlers]:
        logger.removeHandler(h)
        h.close()
    for h in (logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])):
        h.setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
        logger.addHandler(h)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Argument errors end with code 2 before anything starts."""
    p = parser()
    a = p.parse_args(argv)
    if getattr(a, "top_k", 1) < 1:
        p.error("--top-k must be greater than zero")
    if a.what == "ingest":
        try:
            chunks.check_sizes(a.chunk_size, a.chunk_overlap)
        except ValueError as e:
            p.error(str(e))
    log_to(a.log_file)
    spark = spark or SparkSession.builder.appName("siftstone").getOrCreate()
    held = store.Collection(spark, a.store, a.collection_name, create=a.what == "ingest")
    if a.what == "ask":
        print(Chat(held, k=a.top_k, mission=a.mission).ask(a.question))
    elif a.what == "evaluate":
        results = evaluate_batch(sources.questions(spark, a.dataset), held, a.top_k).cache()
        report = batch_report(results, {"dataset": a.dataset, "collection_name": a.collection_name, "top_k": a.top_k, "run_at": datetime.now(UTC).isoformat(timespec="seconds")})
        at = reports.write_report(report, a.output)
        print("\n".join([*reports.report_lines(report, METRICS), at]))
    elif a.delete_source:
        print(held.delete_source(a.delete_source))
    elif a.stats_only:
        held.stats().orderBy("facet", "value").show(200, False)
    else:
        print(ingest_corpus(spark, a.data_path, held, a.update_mode, None, a.chunk_size, a.chunk_overlap, count=models.TokenCounter(a.token_ranks) if a.token_ranks else chunks.by_words))
        if a.test_query:
            for r in retrieve(held, a.test_query, 3).orderBy("rank").collect():
                print(r["rank"], r["id"], r["document"][:200])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
