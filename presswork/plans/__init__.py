"""Registered queries: the operators applied to the given tables."""

from presswork.plans import (
    corpus_queries,
    evaluation_queries,
    storage_queries,
    text_queries,
    training_queries,
    tuning_queries,
    vector_queries,
)
from presswork.plans.registry import ORACLES, QUERIES
from presswork.plans.text_queries import words_per_language as flagship

__all__ = [
    "ORACLES", "QUERIES", "flagship", "corpus_queries", "evaluation_queries", "storage_queries", "text_queries", "training_queries",
    "tuning_queries", "vector_queries",
]
