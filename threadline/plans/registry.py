"""All record queries: importing the modules registers them."""

from threadline.plans import answer_queries, document_queries, outcome_queries, proof_queries, queries, ranking_queries, record_queries, retrieval_queries, rule_queries, span_queries, state_queries, stream_queries, view_queries  # noqa: F401
from threadline.plans.base import ORACLES, QUERIES  # noqa: F401
