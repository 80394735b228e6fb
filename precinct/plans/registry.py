"""All registered queries (importing the modules fills the registry)."""
from precinct.plans import (  # noqa: F401
    explore_queries, feature_queries, model_queries, quality_queries, scoring_queries, source_queries)
from precinct.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
