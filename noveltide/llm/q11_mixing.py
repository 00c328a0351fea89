"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.common import read
from noveltide.llm.mixing import BLOCK, ROUNDS, SEED, mix, taken


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken(mix(read(spark, sf_dir, "documents"), (3.0, 1.0, 2.0)))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op11_mixing": op11_mixing}


def drawn(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


PARTNER = f"(({drawn("'mix:' || s || ':' || pass || ':k:' || r")} % greatest(full_, 1) - x) % greatest(full_, 1) + greatest(full_, 1)) % greatest(full_, 1)"
# Which shard a slot stands in does not change what is taken of a source, so the draws are left out here: slot k of a source.
SQL = {
    "op11_mixing": rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, {drawn(f"'{SEED}:' || doc_id")} as h from documents),
total as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as s from d group by source),
w as (select *, cast([3, 1, 2][(s - 1) % 3 + 1] as double) as w, cast(2 * source_size as double) as lim, 1.5::double * (select sum(source_size) from total) as all_ from total),
b as (select *, all_ - coalesce(sum(lim) over (order by lim / w, s rows between unbounded preceding and 1 preceding), 0) as left_,
  (select sum(w) from w) - coalesce(sum(w) over (order by lim / w, s rows between unbounded preceding and 1 preceding), 0) as weight_left from w),
c as (select *, lim * weight_left <= left_ * w as capped from b),
t as (select s, source, source_size, case when capped then lim else (all_ - (select coalesce(sum(lim), 0) from c where capped)) * w / (select sum(w) from c where not capped) end as target from c),
q as (select *, source_size // {BLOCK} as full_, cast(ceil(source_size / {BLOCK}) as bigint) as blocks, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as passes from t),
p as (select *, case when source_size > 0 then cast(floor(target) as bigint) - passes * source_size else 0 end as rest from q),
slot as (select *, k // blocks as pass, k % blocks as i from (select *, unnest(range(passes * blocks + cast(ceil(rest / {BLOCK}) as bigint))) as k from p)),
turned as (select *, case when i < full_ then list_reduce(list_prepend(i, range(1, {ROUNDS + 1})), lambda x, r: case when
  {drawn("'mix:' || s || ':' || pass || ':b:' || r || ':' || greatest(x, " + PARTNER + ")")} % 2 = 1 then {PARTNER} else x end) else full_ end as block,
  least({BLOCK}, source_size - i * {BLOCK}, (case when pass < passes then source_size else rest end) - i * {BLOCK}) as words from slot),
place as (select d.doc_id, t.s, d.size, sum(d.size) over (partition by t.s order by h, doc_id, size rows unbounded preceding) as e from d join t on t.source is not distinct from d.source where d.size > 0),
piece as (select *, unnest(range((e - size) // {BLOCK}, (e - 1) // {BLOCK} + 1)) as block from (select doc_id, s, size, cast(e as bigint) as e from place)),
part as (select doc_id, piece.s, e, size, sum(case when words is null then 0 else greatest(0, least(e, turned.block * {BLOCK} + words) - greatest(e - size, turned.block * {BLOCK})) end) as taken
  from piece left join turned on turned.s = piece.s and turned.block = piece.block group by all)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken from part join t using (s)
union all select doc_id, size, source_size, target, 0 from d join t on t.source is not distinct from d.source where size = 0""",
}
