"""Query of operator 9.  The pages table has no fetch day; it is derived from page_id over two years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import read
from noveltide.llm.url_lists import evaluate

# A dated list of the query (list, pattern, day, action).
ENTRIES = [
    ("gambling", "casino-win.example.net", "2023-06-01", "add"),
    ("pharmacy", "cheap-pills.example.com", "2024-03-15", "add"),
    ("pharmacy", "cheap-pills.example.com", "2024-09-01", "remove"),
    ("pharmacy", "cheap-pills.example.com", "2025-02-01", "add"),
    ("spam", "tionsh.example.net", "2024-05-01", "add"),
    ("spam", "tionsh.example.net", "2024-06-01", "remove"),
    ("spam", "www.ththhe.example.com", "2024-01-01", "add"),
    ("spam", "www.ththhe.example.com", "2024-01-01", "remove"),
    ("spam", "tionble.example.com/de", "2024-02-01", "add"),
    ("legal", "ththth.example.org", "2024-10-10", "add"),
    ("legal", "ththth.example.org", "2025-01-10", "remove"),
    ("legal", "example.org/es", "2025-06-01", "add"),
    ("legal", "m.tiontion.example.com/en", "2024-01-01", "add"),
    ("legal", "m.tiontion.example.com/en", "2024-07-01", "add"),
    ("legal", "m.tiontion.example.com/en", "2025-07-01", "remove"),
]


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 730 as int))").alias("fetched"))
    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, day string, action string")
    return evaluate(pages, entries).withColumn("fetched", F.col("fetched").cast("string"))


QUERIES = {"op9_url_lists": op9_url_lists}
VALUES = ", ".join(f"('{a}', '{b}', date '{c}', '{d}')" for a, b, c, d in ENTRIES)
SQL = {
    "op9_url_lists": f"""
with entry(list, pattern, day, action) as (values {VALUES}),
daily as (select list, pattern, day, max(action) as action from entry group by list, pattern, day),
span as (select d.list, d.pattern, d.day as valid_from,
         (select min(e.day) from daily e where e.list = d.list and e.pattern = d.pattern and e.day > d.day and e.action = 'remove') as valid_to
         from daily d where d.action = 'add'),
page as (select page_id, url, date '2024-01-01' + cast(page_id % 730 as integer) as fetched,
         regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) as host,
         regexp_replace(regexp_extract(lower(url), '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/+$', '') as path from pages),
hit as (select page_id, list, pattern from page, span
        where fetched >= valid_from and (valid_to is null or fetched < valid_to)
        and (host = split_part(pattern, '/', 1) or ends_with(host, '.' || split_part(pattern, '/', 1)))
        and (not contains(pattern, '/') or path || '/' like '/' || substr(pattern, strpos(pattern, '/') + 1) || '/%')),
found as (select page_id, array_to_string(list_sort(list_distinct(list(list))), ',') as lists,
          array_to_string(list_sort(list_distinct(list(pattern))), ',') as patterns from hit group by page_id)
select p.page_id, p.url, cast(p.fetched as varchar) as fetched, coalesce(f.lists, '') as lists,
       coalesce(f.patterns, '') as patterns, f.lists is not null as blocked
from page p left join found f on p.page_id = f.page_id"""
}
