"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noveltide.llm.common import read
from noveltide.llm.sentence_spans import dedup


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "n_sentences", "n_removed")


QUERIES = {"op6_sentence_spans": op6_sentence_spans}
SQL: dict[str, str] = {}
