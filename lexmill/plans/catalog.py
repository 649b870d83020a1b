"""All queries of the engine with their oracle SQL."""

from __future__ import annotations

from lexmill.plans import document_queries, job_queries, label_queries, store_queries, text_queries, zh_queries

_ALL = {**text_queries.QUERIES, **zh_queries.QUERIES, **job_queries.QUERIES, **store_queries.QUERIES, **document_queries.QUERIES, **label_queries.QUERIES}


def flagship(spark, sf_dir):
    return text_queries.q_flagship(spark, sf_dir)


def queries():
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
