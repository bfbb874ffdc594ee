"""All registered queries of the movie engine, and their oracle SQL."""

from __future__ import annotations

from fovea.plans import analysis_queries, model_queries, movie_queries  # noqa: F401
from fovea.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
