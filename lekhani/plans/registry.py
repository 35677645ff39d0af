"""All queries of the library but those of its optional subpackage."""

from __future__ import annotations

from lekhani.plans import evaluation_queries, report_queries, retrieval_queries, text_queries

_MODULES = [text_queries, retrieval_queries, evaluation_queries, report_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
