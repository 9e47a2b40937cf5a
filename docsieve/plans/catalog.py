"""All registered queries."""

from docsieve.plans import (  # noqa: F401
    evaluation_plans,
    ops_plans,
    question_plans,
    relational_plans,
    retrieval_plans,
    screening_plans,
    streaming_plans,
    text_plans,
)
from docsieve.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
