"""Query of operator 12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.llm.anagrams import LOWER, UPPER, runs, variants, vocabulary
from noveltide.llm.common import read

#: One occurrence in so many loses a letter, by its checksum.
SPOILT = 97


def spoilt(words: DataFrame) -> DataFrame:
    """The occurrences ``id, word``, of which some lose a letter."""
    h, m = F.crc32(F.concat_ws(":", F.col("id").cast("string"), "word")), F.char_length("word")
    at = (F.col("h") % F.col("m")).cast("int")
    cut = F.concat(F.left("word", at), F.right("word", F.col("m") - at - 1))
    return words.select("word", h.alias("h"), m.alias("m")).select(F.when(F.col("h") % SPOILT == 0, cut).otherwise(F.col("word")).alias("word"))


def op12_anagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(spoilt(runs(read(spark, sf_dir, "documents")))))


QUERIES = {"op12_anagrams": op12_anagrams}
# The checksum byte by byte with its table of 256 entries; near words by what is left when a letter goes.
SQL = {
    "op12_anagrams": rf"""
with recursive tab as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i)),
run as (select doc_id, translate(x, '{UPPER}', '{LOWER}') as w, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as x from documents) group by all),
byte as (select w, n, hex(encode(doc_id || ':' || w)) as b from run),
sum_ as (select w, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(b) // 2), lambda i: ('0x' || substr(b, 2 * i + 1, 2))::bigint)),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as h from byte, tab),
word as (select case when h % {SPOILT} = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from sum_),
v as (select word, cast(sum(n) as bigint) as n from word where length(word) >= 5 group by word having sum(n) >= 3),
less as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as r from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
pair as (select a.word as a, b.word as b from less a join less b on a.r = b.r and a.i = b.i and a.word <> b.word
  union select a.word, v.word from less a join v on v.word = a.r union select v.word, a.word from less a join v on v.word = a.r),
near as (select a as word, count(*) as n_near, max(v.n) as m from pair join v on v.word = b group by a),
form as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 2 * v.n then (select min(b) from pair join v y on y.word = b where a = v.word and y.n = m) end as form, case when m >= 2 * v.n then m end as form_n
  from v left join near on near.word = v.word),
up(word, root, next) as (select word, coalesce(form, word), form from form union all select up.word, coalesce(f.form, up.root), f.form from up join form f on f.word = up.next)
select f.word, f.form, u.root, f.n, f.n_near, f.form_n from form f join up u on u.word = f.word and u.next is null"""
}
