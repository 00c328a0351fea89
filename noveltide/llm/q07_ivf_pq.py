"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import read
from noveltide.llm.ivf_pq import search


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op7_ivf_pq": op7_ivf_pq}
SQL: dict[str, str] = {}
