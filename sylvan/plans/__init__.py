"""Registered queries over the given tables."""

from . import review_queries, site_queries, spatial_queries, opportunity_queries, access_queries, misc_queries, package_queries, reader_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
