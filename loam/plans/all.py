"""Imports every module of queries, so that the registry holds them all."""

from . import document_queries, extract_queries, intent_queries, metric_queries, normalize_queries, search_queries, stream_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
