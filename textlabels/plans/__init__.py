"""Registered queries over the given tables."""

from textlabels.plans import (  # noqa: F401  (importing fills the registry)
    evaluation_queries, label_queries, scoring_queries, source_queries, statistics_queries, text_queries,
)
from textlabels.plans.registry import QUERIES, SQL  # noqa: F401
