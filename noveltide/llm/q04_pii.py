"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import read
from noveltide.llm.pii import KINDS, sanitise


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op4_pii": op4_pii}
SQL = {
    "op4_pii": r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
pat(kind, k, p) as (values ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 2, '[0-9]([\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
hit as (select doc_id, kind, k, regexp_extract_all(text, p) as m, string_split_regex(text, p) as g from t, pat),
each as (select doc_id, kind, k, unnest(m) as x, unnest(g[1:len(m)]) as before, unnest(range(1, len(m) + 1)) as i from hit where len(m) > 0),
found as (select doc_id, kind, k, x, regexp_replace(x, '[^0-9]', '', 'g') as d,
  cast(sum(length(before) + length(x)) over (partition by doc_id, kind order by i) as bigint) as e from each),
base as (select doc_id, kind, k, x, e - length(x) as s, e from found where case kind when 'email' then true when 'phone' then length(d) between 8 and 15
  when 'ip' then list_bool_and(list_transform(string_split(x, '.'), lambda v: length(ltrim(v, '0')) < 3 or (length(ltrim(v, '0')) = 3 and ltrim(v, '0') <= '255')))
  else length(d) between 16 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda j: case when j % 2 = 1 then cast(d[length(d) - j + 1] as integer)
    when cast(d[length(d) - j + 1] as integer) > 4 then 2 * cast(d[length(d) - j + 1] as integer) - 9 else 2 * cast(d[length(d) - j + 1] as integer) end)) % 10 = 0 end),
size as (select count(*) as n from t),
entity as (select distinct doc_id, kind, lower(x) as x from base),
n_e as (select kind, x, count(*) as n_e from entity group by all),
word as (select doc_id, w from (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'))) as w from t) where w <> ''),
n_t as (select w, count(*) as n_t from word group by w),
met as (select kind, x, w, count(*) as n_et from entity join word using (doc_id) group by all),
share as (select kind, x, w, ln(n_et * least(1.0, n_et / 3.0) * cast(n as double) / (n_e * greatest(n_t, n_et))) / ln(cast(n as double) / n_e) as share
  from met join n_e using (kind, x) join n_t using (w), size where n_e < n),
hidden as (select distinct w from share where share >= 0.95),
told as (select distinct doc_id, w from entity join share using (kind, x) join word using (doc_id, w) where share >= 0.7 union select doc_id, w from word join hidden using (w)),
tok as (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as x, unnest(string_split_regex(text, '[\p{L}\p{N}]+')) as before,
  unnest(range(1, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) + 2)) as i from t where doc_id in (select doc_id from told)),
place as (select doc_id, x, cast(sum(length(before) + coalesce(length(x), 0)) over (partition by doc_id order by i) as bigint) as e from tok),
term as (select p.doc_id, 'term' as kind, 4 as k, e - length(p.x) as s, e from place p join told on told.doc_id = p.doc_id and told.w = lower(p.x)
  where not exists (select 1 from base b where b.doc_id = p.doc_id and b.s < p.e and p.e - length(p.x) < b.e)),
spans as (select doc_id, kind, k, s, e from base union all select * from term),
per as (select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' order by k, s) as spans, string_agg(kind || ':' || s || ':' || e, ',' order by k, s) filter (k < 4) as base from spans group by doc_id)
select t.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join per on per.doc_id = t.doc_id"""
}
