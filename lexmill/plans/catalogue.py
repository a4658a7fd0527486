"""Registered queries: name to callable, and name to the same query in DuckDB SQL."""

from __future__ import annotations

from . import article_queries, corpus_queries, evaluation_queries, file_queries, group_queries, lemma_queries, pattern_queries, ranking_queries, record_queries  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "freq_stdev_intersection"
