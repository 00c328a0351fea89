"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noveltide.llm.common import read
from noveltide.llm.licences import fit, scan


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(spark, docs))


QUERIES = {"op3_licences": op3_licences}
SQL: dict[str, str] = {}
