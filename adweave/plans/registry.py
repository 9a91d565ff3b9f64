"""Every registered query of the job-ad engine, and its SQL."""

from __future__ import annotations

from adweave.plans import card_queries, job_queries, place_queries, report_queries, result_queries, selection_queries, source_queries, text_queries

MODULES = (text_queries, job_queries, place_queries, report_queries, result_queries, selection_queries, source_queries, card_queries)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
