"""All queries of the engine, with the SQL that they are checked against."""

from __future__ import annotations

from . import answers, jobs, parsers, records, search, state, stores, talks, text

_ALL = search.QUERIES | text.QUERIES | records.QUERIES | state.QUERIES | parsers.QUERIES | talks.QUERIES | stores.QUERIES | answers.QUERIES | jobs.QUERIES


def flagship(spark, sf_dir):
    """Facet-filtered exact cosine top-k."""
    return search.topk_in_facet(spark, sf_dir)


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
