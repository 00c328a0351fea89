"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import read
from noveltide.llm.vbm_wand import build, search


def op13_vbm_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op13_vbm_wand": op13_vbm_wand}
SQL = {
    "op13_vbm_wand": rf"""
with t as (select doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) as w from documents),
tf as (select doc_id, w, count(*) as tf from t group by all),
len as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
size as (select count(*) as n_, cast(sum(n) as bigint) as l_ from len),
df as (select w, count(*) as df from tf group by w),
q as (select item_id, w, count(*) as k from (select item_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) as w from benchmark) group by all),
wt as (select w, cast(floor(1000 * ln((2 * n_ + 2) / (2 * df + 1))) as bigint) as weight from df, size),
hit as (select item_id, doc_id, cast(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_) // l_)))) as bigint) as score
  from q join tf using (w) join wt using (w) join len using (doc_id), size group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from hit where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10"""
}
