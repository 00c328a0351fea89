"""Incremental harvest: each micro-batch appends the articles whose id the table does not have yet."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noveltide.functions.text import decade
from noveltide.operators.manifests import clean, dedup_pages, new_articles
from noveltide.sources import scratch, search_source


def append_new(spark: SparkSession, target: str, batch: DataFrame, id_col: str = "eid") -> None:
    """Appends new articles by decade.  A batch that is run again appends nothing twice."""
    rows = batch.withColumn("decade", decade(F.expr("try_cast(substring(cover_date, 1, 4) as int)")))
    try:
        known = spark.read.parquet(target).select(id_col)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = batch.select(id_col).limit(0)
    clean(new_articles(rows, known, id_col, distinct=True)).write.mode("append").partitionBy("decade").parquet(target)


def run(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, id_col: str = "eid") -> StreamingQuery:
    """Reads the JSON files that arrive in ``source``, each once, until none is left."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda df, _: append_new(spark, target, df, id_col)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def harvest_stream(spark: SparkSession, options: dict[str, str], target: str, checkpoint: str, empty_pages: int = 3) -> int:
    """Follows a search by its cursor (see ``search_pages``) into the table ``target``: ``page, eid, entry``.

    Entries whose id an earlier page had are left out, repeats within a page stay.  The search ends with its last page,
    or after so many pages in a row without anything new.  A batch that is run again appends nothing twice: it has a
    folder of its own.  Returns the number of entries in the table.
    """
    search_source.register(spark)
    idle = {"pages": 0, "ended": False}

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.select("page", F.get_json_object("entry", "$.eid").alias("eid"), "entry")
        own = f"{target}/batch={number}"
        scratch.delete(spark, own)
        known = spark.read.schema("page int, eid string, entry string").parquet(target).where(F.col("batch") < number) if scratch.exists(spark, target) and number else rows.limit(0)
        fresh = new_articles(dedup_pages(rows, page_col="page"), known)
        fresh.write.parquet(own)
        new = {r.page for r in spark.read.parquet(own).select("page").distinct().collect()} if batch.take(1) else set()
        for page in sorted(r.page for r in batch.select("page").distinct().collect()):  # pages of a batch
            idle["pages"] = 0 if page in new else idle["pages"] + 1
            idle["ended"] |= idle["pages"] >= empty_pages

    query = spark.readStream.format("search_pages").options(**options).load().writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
    try:
        # An endless search always has more to come, so the query is watched rather than waited for.
        while query.isActive and not idle["ended"] and query.status["message"] != "Waiting for data to arrive":
            time.sleep(0.1)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return spark.read.parquet(target).count() if scratch.exists(spark, target) else 0
