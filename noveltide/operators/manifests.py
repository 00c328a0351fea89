"""State as tables: what is done, excluded or already there, and the joins that skip it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noveltide.functions.text import nfkc, strip


def stripped_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The distinct non-empty lines of a state file, without white space around them."""
    return lines.select(strip(F.col(column)).alias(column)).where(F.col(column) != "").distinct()


def years_done(lines: DataFrame, column: str = "line") -> DataFrame:
    """``year`` of the lines that hold digits only."""
    return stripped_lines(lines, column).where(F.col(column).rlike("^[0-9]+$")).select(F.expr(f"try_cast({column} as int)").alias("year")).dropna()


def pending_years(spark, done: DataFrame, first: int = 1826, last: int = 2024) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year")).join(done, "year", "left_anti")


def new_articles(batch: DataFrame, existing: DataFrame, id_col: str = "eid", distinct: bool = False) -> DataFrame:
    """Rows with a non-blank id that is not in ``existing``; repeated ids within the batch stay unless ``distinct``."""
    rows = batch.where(F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "")
    fresh = rows.join(existing.select(id_col).distinct(), id_col, "left_anti").select(*batch.columns)
    return fresh.dropDuplicates([id_col]) if distinct else fresh


def clean(rows: DataFrame) -> DataFrame:
    """``rows`` with all text columns normalised."""
    return rows.select(*[nfkc(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def save(batch: DataFrame, existing: DataFrame, id_col: str = "eid") -> DataFrame:
    """What is appended of a batch: new articles, with the values of all text columns cleaned."""
    return clean(new_articles(batch, existing, id_col))


def unprocessed(names: DataFrame, done: DataFrame, column: str = "file") -> DataFrame:
    """Files that the manifest of processed ones does not list."""
    return names.join(stripped_lines(done, column), column, "left_anti")


def fates(rows: DataFrame, progress: DataFrame, excluded: DataFrame, present: DataFrame, quota: int, id_col: str = "eid") -> DataFrame:
    """``id, fate`` of each article: ``done``, ``omitted``, ``existing``, ``fetch``, or ``later`` if the quota ends before."""
    plan = plan_downloads(rows, progress, excluded, present, quota, id_col)
    named = [plan[k].select(id_col, F.lit(k).alias("_fate")) for k in ("fetch", "omitted", "existing")]
    known = named[0].unionByName(named[1]).unionByName(named[2]).unionByName(progress.select(id_col, F.lit("done").alias("_fate"))).distinct()
    return rows.select(id_col).join(known, id_col, "left").select(id_col, F.coalesce("_fate", F.lit("later")).alias("fate"))


def plan_downloads(rows: DataFrame, progress: DataFrame, excluded: DataFrame, present: DataFrame, quota: int, id_col: str = "eid", order: str | None = None) -> dict[str, DataFrame]:
    """What an enrichment run does with each article, as frames: ``fetch``, ``omitted``, ``existing``.

    Articles in progress are skipped silently, excluded ones are logged as omitted, those with a record count as
    existing; of the rest the first ``quota`` by ``order`` (the id) are fetched.
    """
    todo = rows.join(progress.select(id_col).distinct(), id_col, "left_anti")
    bad = excluded.select(id_col).distinct()
    open_ = todo.join(bad, id_col, "left_anti")
    have = present.select(id_col).distinct()
    return {
        "omitted": todo.join(bad, id_col, "left_semi").select(id_col),
        "existing": open_.join(have, id_col, "left_semi").select(id_col),
        "fetch": open_.join(have, id_col, "left_anti").select(*rows.columns).orderBy(order or id_col).limit(quota),
    }


def dedup_pages(entries: DataFrame, id_col: str = "eid", page_col: str = "page") -> DataFrame:
    """Cursor paging: entries whose id no earlier page had; repeats within one page stay."""
    first = entries.groupBy(id_col).agg(F.min(page_col).alias("_first"))
    return entries.join(first, id_col).where(F.col(page_col) == F.col("_first")).select(*entries.columns)


def stop_page(entries: DataFrame, empty_pages: int = 3, id_col: str = "eid", page_col: str = "page") -> DataFrame:
    """The page at which paging stops: the last of the first run of pages that bring nothing new (null: none)."""
    fresh = dedup_pages(entries, id_col, page_col).groupBy(page_col).agg(F.count("*").alias("fresh"))
    pages = entries.select(page_col).distinct().join(fresh, page_col, "left").withColumn("none", F.coalesce("fresh", F.lit(0)) == 0)
    w = Window.orderBy(page_col).rowsBetween(-(empty_pages - 1), 0)  # one row per page of one query
    run = pages.withColumn("run", F.sum(F.col("none").cast("int")).over(w)).where(F.col("run") == empty_pages)
    return run.agg(F.min(page_col).alias("stop_page"))
