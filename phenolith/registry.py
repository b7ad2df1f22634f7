"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import meta, mining, scoring, stats, subjects, text

PARTS = (scoring, stats, text, meta, subjects, mining)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in PARTS:
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
