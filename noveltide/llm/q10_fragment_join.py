"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noveltide.llm.common import read
from noveltide.llm.fragment_join import classes


def op10_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


QUERIES = {"op10_fragment_join": op10_fragment_join}
SQL = {
    "op10_fragment_join": r"""
with recursive doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from doc),
kind as (select min(doc_id) as k, s, len(s) as n from sets where len(s) > 0 group by s),
gram as (select k, n, unnest(s) as g from kind),
link as (select a.k as x, b.k as y from gram a join gram b on a.g = b.g and a.k < b.k and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.k, b.k, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edge as (select x, y from link union select y, x from link),
reach(k, r) as (select k, k from kind union select reach.k, edge.y from reach join edge on edge.x = reach.r),
comp as (select k, min(r) as c from reach group by k)
select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(comp.c, sets.doc_id) as component_id
from sets left join kind on kind.s = sets.s left join comp on comp.k = kind.k"""
}
