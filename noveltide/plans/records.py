"""Queries on JSON records and state tables.  Records are composed of the star schema's rows, so that SQL can tell the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.config import EnrichConfig
from noveltide.functions.text import decade, decade_file, hms
from noveltide.operators import enrich, manifests, reports


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet")


def flatten_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Search entries: every third without authors, every fifth author without a name."""
    c = customers(spark, sf)
    name = F.expr("if(c_custkey % 5 = 0, null, c_name)")
    authors = F.array(F.struct(F.concat(F.lit("a"), "c_custkey").alias("authid"), name.alias("authname")), F.struct(F.lit("b").alias("authid"), F.col("c_mktsegment").alias("authname")))
    fields = {"eid": F.col("c_custkey").cast("string"), "dc:title": F.expr("if(c_custkey % 4 = 0, null, c_name)"), "dc:creator": name, "author": F.when(F.col("c_custkey") % 3 != 0, authors), "prism:coverDate": F.lit("2020-01-01"), "prism:doi": F.lit(None).cast("string"), "citedby-count": F.col("c_nationkey").cast("string")}
    raw = c.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("j"))
    return enrich.flatten_entries(raw.select(F.from_json("j", enrich.ENTRY).alias("entry")))


RECORD = """concat('{"eid":"', c_custkey, '","dc:description":"', c_name, '","citedby-count":"', c_nationkey, '","affiliations":',
 case c_custkey % 4 when 0 then '[]' when 1 then concat('[{"@id":"', c_nationkey, '","affiliation-name":"N', c_nationkey, '"}]')
   when 2 then concat('[{"@id":"', c_nationkey, '"},{"@id":"77","affilname":" Far "}]') else '{"@id":"1"}' end,
 ',"authors":[{"@auid":"', c_custkey, '","preferred-name":{"ce:indexed-name":"', c_mktsegment, '"},"affiliation":{"@id":"', c_nationkey, '"}},',
 '{"@auid":null,"preferred-name":{"ce:indexed-name":""},"affiliation":',
   case c_custkey % 3 when 0 then '{"@id":"77","affilname":"Far"}' when 1 then '[{"@id":"77"}]' else '{"@id":"77","affiliation-name":"Far "}' end, '}],',
 '"keywords":', case c_custkey % 3 when 0 then '[{"$":"alpha"},"beta"]' when 1 then '{"$":"gamma"}' else '"none"' end,
 ',"subject-areas":{"subject-area":', case c_custkey % 3 when 0 then '{"@code":"2601","$":"x"}' when 1 then '[{"@code":"2602","$":"Algebra"},{"@code":"abc","$":"y"},{"@code":"2614","$":"T"}]' else '[{"@code":2615,"$":"z"},{"@code":2604,"$":"A"}]' end,
 '},"item":{"bibrecord":{"head":{"citation-info":{"citation-language":', if(c_custkey % 2 = 0, '{"@xml:lang":"eng"}', '[{"@xml:lang":"fre"},{"@xml:lang":"eng"}]'), '}}}}}')"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select(F.col("c_custkey").alias("eid"), F.expr(f"if(c_custkey % 11 = 0, concat('{{\"eid\":\"', c_custkey, '\",\"error\":\"gone\"}}'), {RECORD})").alias("record"))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a key not divisible by 13 have a record; those divisible by 17 are enriched already."""
    raw = customers(spark, sf).select(F.col("c_custkey").alias("eid"), F.col("c_name").alias("title"))
    return enrich.merge(raw, records(spark, sf).where("eid % 13 <> 0"), raw.where("eid % 17 = 0"))


def enrich_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("eid", "title", "abstract", "citedby_count", F.col("num_authors").cast("long").alias("num_authors"), F.col("num_affiliations").cast("long").alias("num_affiliations"), "idioma")


def authors_join(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("eid", "authors_full", "authors_ids")


def affiliations_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("eid", "affiliations_full", "affiliations_ids")


def subject_area_filter(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("eid", "subject_areas", F.col("num_subdisciplinas").cast("long").alias("num_subdisciplinas"))


def keywords_join(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("eid", "keywords")


def json_projection(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def dedup_new_eids(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as a batch of ids, against the ids of even orders; repeats within the batch stay."""
    batch = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("eid"), "l_linenumber")
    known = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("eid"))
    return manifests.new_articles(batch, known)


def cursor_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as pages: an order's lines stay on the first page that has it."""
    batch = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("eid"), F.col("l_linenumber").alias("page"))
    return manifests.dedup_pages(batch).groupBy("page").agg(F.count("*").alias("n"))


def decade_partition(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    return o.groupBy(decade(F.col("year")).alias("decade"), decade_file(F.col("year")).alias("file")).agg(F.count("*").alias("n"))


def pending_years(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/orders.parquet").select(F.format_string(" %d ", F.year("o_orderdate")).alias("line"))
    return manifests.pending_years(spark, manifests.years_done(lines))


def skip_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to fetch: not in progress (toxic), not excluded (low quality), no record yet (every tenth), by quota."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("eid"))
    lab = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "eid")
    plan = manifests.plan_downloads(d, lab.where("toxic = 1"), lab.where("quality = 0"), d.where("eid % 10 = 0"), EnrichConfig().weekly_quota)
    each = [plan[k].select("eid", F.lit(k).alias("fate")) for k in ("fetch", "omitted", "existing")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def weekly_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.weekly_report(spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("line")))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    outcomes = e.select(F.expr("case when event_type = 'error' then 'error' when event_id % 4 = 0 then 'existing' else 'new' end").alias("outcome"))
    return reports.run_summary(outcomes, "2025_11_11", e.select(F.col("user_id").alias("line")))


def format_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", hms(F.col("event_id") * 7).alias("elapsed"))


def decade_progress(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    per = o.groupBy(F.year("o_orderdate").alias("decade")).agg(F.count("*").cast("double").alias("seconds"))
    return reports.decade_progress(per, 20).withColumn("mean_seconds", F.round("mean_seconds", 6))


def error_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Records that say an error, and (every 23rd) records that cannot be read."""
    r = records(spark, sf).withColumn("record", F.expr("if(eid % 23 = 0, substring(record, 1, 12), record)"))
    return enrich.quarantine(r)


def processed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files named by the order years; those of even years are in the manifest, with white space around the names."""
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    names = o.select(F.format_string("articles_%d.csv", "year").alias("file")).distinct()
    return manifests.unprocessed(names, o.where("year % 2 = 0").select(F.format_string(" articles_%d.csv ", "year").alias("file")))


def nfkc_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with a decomposed letter and a ligature; parts of some suppliers are there already."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("eid"), F.concat("p_name", F.lit("e\u0301 \ufb01 \u2460")).alias("title"))
    return manifests.save(p, p.where("eid % 3 = 0").select("eid"))


def download_fates(spark: SparkSession, sf: str) -> DataFrame:
    """What a run under the production quota does with each document (those of toxic texts are done, bad ones excluded)."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("eid"))
    lab = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "eid")
    return manifests.fates(d, lab.where("toxic = 1").select("eid"), lab.where("quality = 0").select("eid"), d.where("eid % 10 = 0"), EnrichConfig().weekly_quota)


KEPT = "from customer where c_custkey % 13 <> 0 and c_custkey % 17 <> 0 and c_custkey % 11 <> 0"
FAR = "if(c_custkey % 3 = 1, '', if({has}, '; ', '') || 'Far')"
QUERIES = {
    f.__name__: f
    for f in (
        flatten_entries, enrich_merge, authors_join, affiliations_resolve, subject_area_filter, keywords_join, json_projection, dedup_new_eids, cursor_pages, decade_partition,
        pending_years, skip_excluded, error_quarantine, processed_files, nfkc_clean, download_fates, weekly_report, run_summary, format_seconds, decade_progress,
    )
}
SQL = {
    "flatten_entries": """select cast(c_custkey as varchar) as eid, if(c_custkey % 4 = 0, '', c_name) as title, if(c_custkey % 5 = 0, '', c_name) as first_author_name,
if(c_custkey % 3 = 0, '', 'a' || c_custkey) as first_author_id, if(c_custkey % 3 = 0, '', if(c_custkey % 5 = 0, '', c_name) || '; ' || c_mktsegment) as all_authors,
if(c_custkey % 3 = 0, '', 'a' || c_custkey || '; b') as author_ids, '2020-01-01' as cover_date, '' as doi, cast(c_nationkey as varchar) as cited_by from customer""",
    "enrich_merge": f"""select c_custkey as eid, c_name as title, c_name as abstract, cast(c_nationkey as varchar) as citedby_count, cast(1 as bigint) as num_authors,
cast(if(c_custkey % 3 = 1, 1, 2) as bigint) as num_affiliations, if(c_custkey % 2 = 0, 'eng', 'fre') as idioma {KEPT}""",
    "authors_join": f"select c_custkey as eid, c_mktsegment as authors_full, cast(c_custkey as varchar) as authors_ids {KEPT}",
    "affiliations_resolve": f"""select c_custkey as eid, if(c_custkey % 4 = 1, 'N' || c_nationkey, '(sin nombre)') || if(c_custkey % 3 = 1, '', '; Far') as affiliations_full,
case c_custkey % 4 when 1 then cast(c_nationkey as varchar) when 2 then c_nationkey || '; 77' else c_nationkey || if(c_custkey % 3 = 1, '', '; 77') end as affiliations_ids {KEPT}""",
    "subject_area_filter": f"""select c_custkey as eid, case c_custkey % 3 when 0 then '' when 1 then '2602-Algebra; 2614-T' else '2604-A' end as subject_areas,
cast(case c_custkey % 3 when 0 then 0 when 1 then 2 else 1 end as bigint) as num_subdisciplinas {KEPT}""",
    "keywords_join": f"select c_custkey as eid, case c_custkey % 3 when 0 then 'alpha; beta' when 1 then 'gamma' else '' end as keywords {KEPT}",
    "json_projection": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "dedup_new_eids": "select l_orderkey as eid, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 2 = 0)",
    "cursor_pages": "select l_linenumber as page, count(*) as n from lineitem l where l_linenumber = (select min(m.l_linenumber) from lineitem m where m.l_orderkey = l.l_orderkey) group by 1",
    "decade_partition": "select cast(year(o_orderdate) // 10 * 10 as integer) as decade, 'articles_' || (year(o_orderdate) // 10 * 10) || '_' || (year(o_orderdate) // 10 * 10 + 9) || '.csv' as file, count(*) as n from orders group by 1, 2",
    "pending_years": "select cast(y as integer) as year from range(1826, 2025) t(y) where y not in (select year(o_orderdate) from orders)",
    "skip_excluded": """with todo as (select doc_id as eid from documents where doc_id not in (select doc_id from labels where toxic = 1)),
bad as (select doc_id from labels where quality = 0)
select eid, fate from (select eid, 'fetch' as fate from todo where eid not in (select * from bad) and eid % 10 <> 0 order by eid limit 150000)
union all select eid, 'omitted' from todo where eid in (select * from bad)
union all select eid, 'existing' from todo where eid not in (select * from bad) and eid % 10 = 0""",
    "error_quarantine": "select c_custkey as eid, if(c_custkey % 23 = 0, 'unreadable record', 'gone') as error from customer where c_custkey % 11 = 0 or c_custkey % 23 = 0",
    "processed_files": "select distinct 'articles_' || year(o_orderdate) || '.csv' as file from orders where year(o_orderdate) % 2 <> 0",
    "nfkc_clean": "select p_partkey as eid, p_name || 'é fi 1' as title from part where p_partkey % 3 <> 0",
    "download_fates": """with done as (select doc_id from labels where toxic = 1), bad as (select doc_id from labels where quality = 0)
select doc_id as eid, case when doc_id in (select * from done) then 'done' when doc_id in (select * from bad) then 'omitted' when doc_id % 10 = 0 then 'existing'
when row_number() over (partition by doc_id in (select * from done) or doc_id in (select * from bad) or doc_id % 10 = 0 order by doc_id) <= 150000 then 'fetch' else 'later' end as fate from documents""",
    "weekly_report": """with p as (select count(distinct l_orderkey) as n from lineitem)
select n as progreso_total, round_even(n / 3640783 * 100, 2) as porcentaje_total, cast(round_even((3640783 - n) / 150000, 0) as bigint) as estimacion_semanas_restantes from p""",
    "run_summary": """with p as (select count(distinct user_id) as n from events)
select '2025_11_11' as semana, count(*) filter (event_type <> 'error' and event_id % 4 <> 0) as descargados_nuevos, count(*) filter (event_type <> 'error' and event_id % 4 = 0) as existentes,
count(*) filter (event_type = 'error') as errores, max(n) as progreso_total, round_even(max(n) / 3640783 * 100, 2) as porcentaje_total, cast(round_even((3640783 - max(n)) / 150000, 0) as bigint) as estimacion_semanas_restantes from events, p""",
    "format_seconds": "select event_id, (event_id * 7 // 3600) || 'h ' || (event_id * 7 % 3600 // 60) || 'm ' || (event_id * 7 % 60) || 's' as elapsed from events",
    "decade_progress": """with d as (select year(o_orderdate) as y, count(*) as s from orders group by 1), a as (select count(*) as done, avg(s) as m from d),
e as (select done, m, cast(floor(m * (20 - done)) as bigint) as t from a)
select done, round(m, 6) as mean_seconds, (t // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's' as eta from e""",
}
