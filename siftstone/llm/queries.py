"""The corpus operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from .audit import AUDIT_SQL, filter_audit
from .common import table
from .decontam import CONTAMINATION_SQL, contamination_digest
from .linededup import LINE_SQL, line_digest
from .mixing import mix_digest
from .pii import pii_digest
from .quality import scores, train
from .secrets import secret_digest
from .sharding import shard_digest
from .simhash import near_duplicate_digest
from .tokens import token_digest
from .topk import TOP_K_SQL, vector_top_k
from .urls import url_verdicts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine has the public vocabulary; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    docs = lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))
    return {
        "op1_pii_spans": docs(pii_digest),
        "op2_exact_top_k": lambda spark, sf_dir: vector_top_k(table(spark, sf_dir, "embeddings")),
        "op3_secret_spans": docs(lambda d: secret_digest(d, tokenizer_path("byte_bpe_50k.tiktoken"))),
        "op4_url_verdicts": lambda spark, sf_dir: url_verdicts(table(spark, sf_dir, "pages")),
        "op5_sampled_shards": docs(shard_digest),
        "op6_line_spread": docs(line_digest),
        "op7_source_mix": docs(mix_digest),
        "op8_quality_scores": lambda spark, sf_dir: scores(table(spark, sf_dir, "documents"), train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))),
        "op9_simhash_groups": docs(near_duplicate_digest),
        "op10_contamination": lambda spark, sf_dir: contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op11_filter_audit": lambda spark, sf_dir: filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op12_token_counts": docs(lambda d: token_digest(d, tokenizer_path())),
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op2_exact_top_k": TOP_K_SQL, "op6_line_spread": LINE_SQL, "op10_contamination": CONTAMINATION_SQL, "op11_filter_audit": AUDIT_SQL}
