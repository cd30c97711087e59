"""Importing the package fills the registry."""

from tidemark.catalog import (  # noqa: F401
    descriptive,
    evaluation_queries,
    extraction,
    feedback_queries,
    job_queries,
    network_queries,
    preparation,
    scenario_queries,
    series_queries,
    statistics,
)
from tidemark.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
