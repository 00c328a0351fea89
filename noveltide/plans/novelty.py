"""Queries on the novelty index and document vectors.

Articles are the embeddings, dated by the order of the same key; windows are one year, as the dates span few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.functions import vectors as V
from noveltide.operators import novelty, reports, vectors, word2vec

YEARS = 1


def articles(spark: SparkSession, sf: str) -> DataFrame:
    e, o = spark.read.parquet(f"{sf}/embeddings.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    return e.join(o, e.vec_id == o.o_orderkey).select(e.vec_id.alias("eid"), F.to_date("o_orderdate").alias("cover_date"), e.embedding.alias("vector"), e.label, o.o_orderpriority.alias("title"))


def ki_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.index(articles(spark, sf), YEARS).withColumn("ki_score", F.round("ki_score", 6))


def ki_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.index(articles(spark, sf), YEARS).withColumn("ki_score", F.round("ki_score", 6))


def ki_past_future_pools(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.pools(novelty.prepare(articles(spark, sf)), YEARS).select("eid", "past_pool_size", "future_pool_size", F.round("past_dot", 5).alias("past_dot"), F.round("future_dot", 5).alias("future_dot"))


def ki_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.eligible(novelty.prepare(articles(spark, sf)), YEARS).select("eid", F.col("ord").cast("long").alias("ord"))


def unit_vectors_norm(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.prepare(articles(spark, sf)).select("eid", F.round(V.norm(F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("u0"))


def ki_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return novelty.with_metadata(a, ki_semantic(spark, sf)).withColumn("cover_date", F.col("cover_date").cast("string"))


def ki_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Three articles and more share an id: each has its score, and meets the metadata of all of them."""
    a = articles(spark, sf).withColumn("key", F.col("eid")).withColumn("eid", F.col("eid") % 150)
    out = novelty.with_metadata(a, novelty.index(a, YEARS, tie_col="key"))
    return out.withColumn("ki_score", F.round("ki_score", 6)).withColumn("cover_date", F.col("cover_date").cast("string"))


def ki_describe(spark: SparkSession, sf: str) -> DataFrame:
    row = reports.describe(novelty.index(articles(spark, sf), YEARS), "ki_score")
    return row.select("n", *[F.round(c, 6).alias(c) for c in row.columns[1:]])


def zero_vector_report(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf).withColumn("vector", F.when(F.col("eid") % 7 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")))
    return vectors.zero_report(a).withColumn("zero_pct", F.round("zero_pct", 6))


def norm_histogram(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/customer.parquet").select(F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("vector"))
    return word2vec.histogram(word2vec.norms(a), "norm")


def masked_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Pools the four quarters of an embedding as token vectors; the mask depends on the key."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("v", V.doubles(F.col("embedding")))
    hidden = F.array(*[F.slice("v", 16 * k + 1, 16) for k in range(4)])
    mask = F.array(*[(F.col("vec_id") % (k + 2) != 0).cast("int") for k in range(4)])
    return e.select("vec_id", F.posexplode(vectors.masked_mean(hidden, mask)).alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


UNIT = """
vec as (select vec_id as eid, cast(o_orderdate as date) as d, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as ord,
  list_transform(embedding, lambda x: cast(x as double)) as v, o_orderpriority as title
  from embeddings join orders on o_orderkey = vec_id where embedding is not null and o_orderdate is not null),
unit as (select eid, d, ord, title, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) as u from vec)"""
PAIRS = """
pool as (select t.eid, t.ord,
  count(k.eid) filter ((k.ord, k.eid) < (t.ord, t.eid)) as past_pool_size,
  count(k.eid) filter ((k.ord, k.eid) > (t.ord, t.eid)) as future_pool_size,
  coalesce(sum(list_inner_product(t.u, k.u)) filter ((k.ord, k.eid) < (t.ord, t.eid)), 0) as past_dot,
  coalesce(sum(list_inner_product(t.u, k.u)) filter ((k.ord, k.eid) > (t.ord, t.eid)), 0) as future_dot
  from unit t left join unit k on k.ord between t.ord - 365 and t.ord + 365 and k.eid <> t.eid group by t.eid, t.ord)"""
KI = f"""{UNIT}, {PAIRS},
ends as (select min(ord) as lo, max(ord) as hi from unit),
ki as (select eid, ln((case when future_pool_size > 0 then greatest((future_pool_size + future_dot) / 2, 1e-9) else 1e-9 end) /
  (case when past_pool_size > 0 then greatest((past_pool_size + past_dot) / 2, 1e-9) else 1e-9 end)) as ki, past_pool_size, future_pool_size
  from pool, ends where ord >= lo + 365.25 and ord <= hi - 365.25)"""
ONE = f"with {KI} select eid, round(ki, 6) as ki_score, past_pool_size, future_pool_size from ki"

QUERIES = {
    f.__name__: f
    for f in (ki_semantic, ki_prefix, ki_past_future_pools, ki_eligible, unit_vectors_norm, ki_with_metadata, ki_repeated_ids, ki_describe, zero_vector_report, norm_histogram, masked_mean_pool)
}
SQL = {
    "ki_semantic": ONE,
    "ki_prefix": ONE,
    "ki_past_future_pools": f"with {UNIT}, {PAIRS} select eid, past_pool_size, future_pool_size, round(past_dot, 5) as past_dot, round(future_dot, 5) as future_dot from pool",
    "ki_eligible": f"with {UNIT}, ends as (select min(ord) as lo, max(ord) as hi from unit) select eid, ord from unit, ends where ord >= lo + 365.25 and ord <= hi - 365.25",
    "unit_vectors_norm": f"with {UNIT} select eid, round(sqrt(list_sum(list_transform(u, lambda y: y * y))), 6) as norm, round(u[1], 6) as u0 from unit",
    "ki_with_metadata": f"with {KI} select ki.eid, unit.title, cast(unit.d as varchar) as cover_date, round(ki, 6) as ki_score, past_pool_size, future_pool_size from ki join unit on unit.eid = ki.eid",
    # Order by (day, id, key) instead of (day, id); then every score of an id beside every article of it.
    "ki_repeated_ids": f"""with {KI.replace("(k.ord, k.eid) <", "(k.ord, k.eid % 150, k.eid) <").replace("(k.ord, k.eid) >", "(k.ord, k.eid % 150, k.eid) >").replace("(t.ord, t.eid))", "(t.ord, t.eid % 150, t.eid))")}
select unit.eid % 150 as eid, unit.title, cast(unit.d as varchar) as cover_date, round(ki, 6) as ki_score, past_pool_size, future_pool_size from ki join unit on unit.eid % 150 = ki.eid % 150""",
    "ki_describe": f"""with {KI} select count(ki) as n, round(avg(ki), 6) as mean, round(stddev_samp(ki), 6) as std, round(min(ki), 6) as min,
round(quantile_cont(ki, 0.25), 6) as q25, round(quantile_cont(ki, 0.5), 6) as q50, round(quantile_cont(ki, 0.75), 6) as q75, round(max(ki), 6) as max from ki""",
    "zero_vector_report": f"with {UNIT} select count(*) as n, count(*) filter (eid % 7 = 0) as zero_vectors, round(count(*) filter (eid % 7 = 0) / count(*) * 100.0, 6) as zero_pct from vec",
    "norm_histogram": """with n as (select sqrt(c_acctbal * c_acctbal + cast(c_nationkey as double) * c_nationkey) as x from customer), e as (select min(x) as lo, max(x) as hi from n)
select cast(least(40, floor((x - lo) / (hi - lo) * 40) + 1) as integer) as bin, count(*) as n from n, e group by 1""",
    "masked_mean_pool": """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v,
[cast(vec_id % 2 <> 0 as integer), cast(vec_id % 3 <> 0 as integer), cast(vec_id % 4 <> 0 as integer), cast(vec_id % 5 <> 0 as integer)] as m from embeddings),
d as (select vec_id, v, m, unnest(range(16)) as dim from e)
select vec_id, dim, round((v[dim + 1] * m[1] + v[dim + 17] * m[2] + v[dim + 33] * m[3] + v[dim + 49] * m[4]) / greatest(list_sum(m), 1e-9), 6) as x from d""",
}
