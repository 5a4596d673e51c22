"""Queries: what a user runs, composed from the operators."""

from citelens.plans import candidate_queries, mart_queries, metric_queries, model_queries, nested_queries, programs, report_queries, serp_queries, text_queries, url_queries  # noqa: F401
