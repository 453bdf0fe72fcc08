"""The jobs as queries: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

import uuid

from ..session import shared_dir
from .base import ALPHA, DIGIT, PUNCT, collapse, n_of, strip


def chunk_ingest(spark, sf_dir):
    """The incremental ingest; its second run finds nothing new."""
    from jobs import chunk_ingest as job

    at = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        job.ingest(spark, f"{sf_dir}/documents.parquet", f"{at}/chunks", f"{at}/mark")
    return job.stored(spark, f"{at}/chunks").drop("batch")


def curated_corpus(spark, sf_dir):
    """The curated corpus, written and written again."""
    from jobs import curate as job

    at = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        job.curate(spark, f"{sf_dir}/documents.parquet", at)
    return spark.read.schema(job.ROWS).parquet(f"{at}/documents")


_CHUNKS = rf"""WITH t AS (SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS mission, source, {strip('text')} AS s,
  sha256(concat_ws(chr(1), coalesce(nullif(lang, ''), 'unknown'), source, text)) AS digest FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT * FROM t WHERE s <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY digest) = 1),
w AS (SELECT *, string_split_regex(s, '\s+') AS k FROM o),
c AS (SELECT *, CASE WHEN len(k) <= 500 THEN 1 ELSE ceil((len(k) - 100) / 400.0)::INT END AS total FROM w),
x AS (SELECT *, unnest(range(total)) AS i FROM c)
SELECT doc_id, regexp_replace(lower(mission), '[^a-z0-9]+', '_', 'g') || '::' || regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g') || '_' || doc_id || '::chunk_' || lpad(i::VARCHAR, 4, '0') AS id,
  source, i::INT AS chunk_index, total AS total_chunks, len(k[i * 400 + 1 : i * 400 + 500])::INT AS token_count,
  CASE WHEN total = 1 THEN s ELSE array_to_string(k[i * 400 + 1 : i * 400 + 500], ' ') END AS document, mission FROM x"""

_JOINED = r"regexp_replace(regexp_replace(coalesce(text, ''), '([A-Za-z]+)-\s*\n\s*([a-z]+)', '\1\2', 'g'), '\s*\n\s*', ' ', 'g')"
_WORDS = n_of("document", "[A-Za-z]{2,}")
_CURATED = rf"""WITH t AS (SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS mission, source, {collapse(_JOINED)} AS document FROM documents),
k AS (SELECT *, sha256(lower(document)) AS digest FROM t),
o AS (SELECT digest, doc_id, min({{'mission': mission, 'source': source, 'document': document}}) AS d, count(*) AS copies FROM k GROUP BY ALL),
f AS (SELECT doc_id, d.mission AS mission, d.source AS source, d.document AS document, digest, copies, min(doc_id) OVER (PARTITION BY digest) AS first,
  CASE WHEN d.document = '' THEN 0 ELSE len(string_split(d.document, ' ')) END::INT AS n_words FROM o),
s AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'no_id' WHEN document = '' THEN 'blank' WHEN n_words < 5 THEN 'short'
  WHEN {_WORDS} = 0 OR ({_WORDS} < 5 AND {n_of('document', DIGIT)} + {n_of('document', PUNCT)} > greatest({n_of('document', ALPHA)}, 1)) THEN 'noise'
  WHEN first < doc_id THEN 'duplicate' ELSE 'kept' END AS status FROM f)
SELECT doc_id, source, n_words, copies, digest, CASE WHEN status = 'kept' THEN document END AS document, status, mission FROM s"""

QUERIES = {"job1_chunk_ingest": (chunk_ingest, _CHUNKS), "job2_curated_corpus": (curated_corpus, _CURATED)}
