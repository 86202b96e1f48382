"""All queries of the reference's own operators, and the SQL that says the same."""

from __future__ import annotations

from lumenspan.plans import acceptance_queries, concept_queries, evidence_queries, library_queries, relation_queries, review_queries, rule_queries, service_queries, signal_queries, source_queries, summary_queries, text_queries


def queries():
    return acceptance_queries.QUERIES | concept_queries.QUERIES | evidence_queries.QUERIES | library_queries.QUERIES | review_queries.QUERIES | relation_queries.QUERIES | rule_queries.QUERIES | service_queries.QUERIES | signal_queries.QUERIES | source_queries.QUERIES | summary_queries.QUERIES | text_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return acceptance_queries.SQL | concept_queries.SQL | evidence_queries.SQL | library_queries.SQL | review_queries.SQL | relation_queries.SQL | rule_queries.SQL | service_queries.SQL | signal_queries.SQL | source_queries.SQL | summary_queries.SQL | text_queries.SQL
