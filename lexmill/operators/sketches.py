"""Distinct counts as stored sketches: one for each group and day, merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: 2**12 give a standard error of about 1.6 %.
LOG_K = 12


def sketch(rows: DataFrame, value: str, *keys: str, log_k: int = LOG_K) -> DataFrame:
    """keys and a sketch of the distinct values of each group; null values do not count."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.hll_sketch_agg(value, log_k).alias("sketch"))


def merge(stored: DataFrame, *keys: str) -> DataFrame:
    """The union of sketches by fewer keys; values that are in several count once."""
    return stored.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def add(stored: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Stored sketches with new ones taken in. Taking the same ones in again changes no count."""
    return merge(stored.select(*keys, "sketch").unionByName(new.select(*keys, "sketch")), *keys)


def estimate(stored: DataFrame, name: str = "n") -> DataFrame:
    return stored.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def document_frequency(counts: DataFrame, *keys: str) -> DataFrame:
    """Sketches of the documents of each term (keys, term) from counts (keys, doc_id, term)."""
    return sketch(counts, "doc_id", *keys, "term")
