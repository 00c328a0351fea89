"""The sink of harvested articles: a folder of CSV files per decade, and the ids that are there.

Pages are gathered and written a few thousand articles at a time: one Spark job per batch instead of one per page.  A
batch is compared with a table of ids (by decade), never with the articles; Spark's committer makes it visible as a whole or
not at all.  A batch's articles come before its ids, so a run that was killed between the two leaves articles without
ids; these are found once, when the decade is first written to again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.operators import enrich, manifests
from noveltide.sources import files, scratch


class DecadeSink:
    def __init__(self, spark: SparkSession, articles: str, ids: str, batch: int = 5000):
        self.spark, self.articles, self.ids, self.batch = spark, articles.rstrip("/"), ids.rstrip("/"), batch
        self.pages: dict[int, list[dict]] = {}
        self.checked: set[int] = set()
        self.jobs = 0

    def target(self, decade: int) -> str:
        return f"{self.articles}/articles_{decade}_{decade + 9}.csv"

    def known(self, decade: int) -> DataFrame:
        """The ids of a decade's articles."""
        path, target = f"{self.ids}/decade={decade}", self.target(decade)
        if decade not in self.checked:
            self.checked.add(decade)
            if scratch.exists(self.spark, target):
                there = files.read_csv(self.spark, target).select("eid")
                if scratch.exists(self.spark, path):
                    there = there.join(self.spark.read.schema("eid string").parquet(path), "eid", "left_anti")
                there.where("eid is not null").distinct().write.mode("append").parquet(path)
        return self.spark.read.schema("eid string").parquet(path) if scratch.exists(self.spark, path) else self.spark.createDataFrame([], "eid string")

    def add(self, year: int, entries: list[dict]) -> int:
        """Takes a page; the number of articles that were written meanwhile."""
        decade = year // 10 * 10
        self.pages.setdefault(decade, []).extend(entries)
        return self.flush(decade) if len(self.pages[decade]) >= self.batch else 0

    def flush(self, *decades: int) -> int:
        """Writes what has been gathered (of all decades, if none is named); the number of articles.

        Articles whose id is there already are left out; repeats within a batch stay.
        """
        written = 0
        for decade in decades or tuple(self.pages):
            entries = self.pages.pop(decade, [])
            if not entries:
                continue
            self.jobs += 1
            raw = self.spark.createDataFrame([(json.dumps(e),) for e in entries], "j string")
            rows = enrich.flatten_entries(raw.select(F.from_json("j", enrich.ENTRY).alias("entry")))
            with scratch.Scratch(self.spark, "decade") as place:
                fresh = place.write(manifests.save(rows, self.known(decade)).coalesce(1), "fresh")
                n = fresh.count()
                if n:
                    files.write_csv(fresh, self.target(decade))
                    fresh.select("eid").distinct().write.mode("append").parquet(f"{self.ids}/decade={decade}")
            written += n
        return written
