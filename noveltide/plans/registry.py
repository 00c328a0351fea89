"""All queries of the library proper, by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noveltide.plans import novelty, records, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = novelty.QUERIES | text.QUERIES | records.QUERIES
SQL: dict[str, str] = novelty.SQL | text.SQL | records.SQL
