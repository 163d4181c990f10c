"""Queries that bind the operators to the given tables."""

from strophe.plans import (  # noqa: F401
    array_queries,
    chain_queries,
    feature_queries,
    model_queries,
    pedigree_queries,
    ranking_queries,
    segment_queries,
    sequence_queries,
    stream_queries,
    vector_queries,
)
from strophe.plans.registry import ORACLES, QUERIES  # noqa: F401
