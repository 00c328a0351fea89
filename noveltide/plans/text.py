"""Queries on documents as articles: the first line is the title, the rest the abstract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.functions.text import word_count
from noveltide.operators import langid, phrases, preprocess, reports, vectors, word2vec
from noveltide.sources import files, scratch


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("doc_id").alias("eid"), F.substring_index("text", "\n", 1).alias("title"), F.expr("substring(text, char_length(substring_index(text, '\n', 1)) + 2)").alias("abstract"), "lang", "source")


def detected(spark: SparkSession, sf: str) -> DataFrame:
    return langid.detect(articles(spark, sf))


def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", langid.stop_word_detector(F.col("text")).alias("r"))
    return d.select("doc_id", "r.lang", F.round(F.col("r.conf").cast("double"), 5).alias("conf"))


def lang_filter_ok(spark: SparkSession, sf: str) -> DataFrame:
    return langid.split(detected(spark, sf))[0].select("eid", "lang_abstract", "lang_title", F.md5("text").alias("text_md5"))


def lang_filter_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return langid.split(detected(spark, sf))[1].select("eid", "lang_abstract", "lang_title")


def lang_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.count_languages(detected(spark, sf))


def compose_text(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return a.select("eid", F.md5(langid.compose(F.col("title"), F.col("abstract"))).alias("text_md5"), word_count(F.col("abstract")).cast("long").alias("n_words"))


def header_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables with different columns under one header; what is missing is empty."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("string").alias("eid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("venue"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("eid"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("country"), F.lit("x").alias("idioma"))
    return files.union([c, s], extra=("origin",))


def meta_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Boilerplate is woven into the texts first, so that there is something to clean."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    dirty = F.concat(F.lit("Copyright 2020 ELSEVIER  "), F.col("text"), F.lit(" Tous droits RÉSERVÉS, Addison-Wesley\t"))
    return d.select("doc_id", F.md5(preprocess.clean_boilerplate(dirty)).alias("text_md5"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("eid", preprocess.tokenize(F.col("abstract")).alias("tokens"))


def tokens_clean(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf).select("eid", preprocess.kept_lemmas(F.col("tokens")).alias("kept"), F.size("tokens").cast("long").alias("n_tokens"))
    return t.select("eid", "n_tokens", F.size("kept").cast("long").alias("n_kept"), F.md5(F.array_join("kept", " ")).alias("kept_md5"))


def discard_log(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.discard_log(tokens(spark, sf))


def discard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.discard_summary(discard_log(spark, sf))


def meta_token_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The bad tokens are planted between the words of the part names."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    bad = F.array(F.lit("Press"), F.lit("wiley_vch_gmbh"), F.lit("réservés"), F.lit("pressure"))
    return p.select("p_partkey", F.array_join(preprocess.drop_meta_tokens(F.concat(F.split("p_name", " "), bad)), " ").alias("kept"))


PHRASES = ["small ring", "ring_gear", "steel"]


def phrase_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    words = p.select("p_partkey", F.split(F.concat_ws(" ", F.lit("the"), "p_name", F.lit("Gear of R")), " ").alias("tokens"))
    out = preprocess.phrases_first(words, spark.createDataFrame([(x,) for x in PHRASES], "phrase string"), "p_partkey")
    return out.select("p_partkey", F.array_join("tokens", " ").alias("tokens"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as lower-case words of more than two letters."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("doc_id").alias("eid"), F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.char_length(w) > 2).alias("tokens"))


def bigram_scores(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.learn(corpus(spark, sf), min_count=5, threshold=10).withColumn("score", F.round("score", 4))


def bigram_apply(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    merged = phrases.apply(c, phrases.learn(c, min_count=5, threshold=10))
    return merged.select("eid", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def bigram_apply_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Bigrams in documents of which many share an id."""
    c = corpus(spark, sf)
    merged = phrases.apply(c.withColumn("eid", F.col("eid") % 100), phrases.learn(c, min_count=5, threshold=10))
    return merged.select("eid", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


DIM = 200


def word_vectors(c: DataFrame) -> DataFrame:
    """A deterministic table of word vectors in production size: words of the corpus that occur five times or more."""
    v = word2vec.vocabulary(c).where("n >= 5")
    seed = F.char_length("word") * 31 + F.ascii("word") * 7 + F.col("n") % 97
    return v.select("word", "n", F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda j: ((seed * j) % 101 - 50).cast("float")).alias("vector"))


def vocab_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return word2vec.thresholds(word2vec.vocabulary(corpus(spark, sf)))


def w2v_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return word2vec.vocabulary(corpus(spark, sf)).where("n >= 2")


def doc_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    return vectors.coverage(c, word_vectors(c)).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


SHOWN = (1, 38, 77, 123, 200)  # dimensions that the queries return


def mean_digest(r: DataFrame) -> DataFrame:
    return r.select("eid", F.round("coverage_ratio", 6).alias("coverage_ratio"), *[F.round(F.get("vector", F.lit(j - 1)).cast("double"), 3).alias(f"v{j}") for j in SHOWN], F.size("vector").alias("dim"))


def doc_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    return mean_digest(vectors.mean_vectors(c, word_vectors(c), DIM))


def doc_mean_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vectors of documents of which many share an id."""
    c = corpus(spark, sf)
    return mean_digest(vectors.mean_vectors(c.withColumn("eid", F.col("eid") % 100), word_vectors(c), DIM))


def coverage_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    return vectors.sample_coverage(word2vec.sample_docs(c), word_vectors(c)).select(F.round("coverage_sample", 6).alias("coverage_sample"))


def sample_docs(spark: SparkSession, sf: str) -> DataFrame:
    return word2vec.sample_docs(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("eid"), "lang"))


def kv_size_mb(spark: SparkSession, sf: str) -> DataFrame:
    v = word2vec.vocabulary(corpus(spark, sf)).agg(F.count("*").alias("vocab_size"))
    return v.select("vocab_size", word2vec.kv_megabytes(F.col("vocab_size"), F.lit(200)).alias("kv_size_mb_est"))


def w2v_grid_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Grid rows and metrics from the vocabulary, without training."""
    grid = word2vec.read_grid(spark.createDataFrame([(100, 5, 2, 1, 5), (200, 10, 3, 1, 12), (50, 5, 1, 1, 3)], "vector_size int, window int, min_count int, sg int, epochs int"))
    c = corpus(spark, sf)
    v = word2vec.thresholds(word2vec.vocabulary(c))
    norm = word2vec.norms(word_vectors(c)).agg(F.avg("norm").alias("avg_norm"))
    both = grid.join(v, "min_count").crossJoin(norm)
    return both.select("modelo_id", "seed", F.col("kept").alias("vocab_size"), word2vec.kv_megabytes(F.col("kept"), F.col("vector_size")).alias("kv_size_mb_est"), F.round(word2vec.score(F.col("kept"), F.col("avg_norm"), F.lit(0.5)), 2).alias("score"))


def w2v_train(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary and the dimension of a model of production (its values are those of the trainer)."""
    words, _, _ = word2vec.train(corpus(spark, sf), word2vec.TrainParams())
    return words.select("word", F.size("vector").alias("dim"))


def w2v_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Models of both objectives and one that cannot be trained, with those metrics that do not depend on chance."""
    grid = word2vec.read_grid(spark.createDataFrame([(24, 4, 5, 1, 2), (24, 4, 20, 0, 2), (24, 4, 5, 7, 1)], "vector_size int, window int, min_count int, sg int, epochs int"))
    with scratch.Scratch(spark, "grid") as place:
        out = word2vec.run_grid(corpus(spark, sf), grid, word2vec.ModelStore(spark, f"{place.root}/models"))
    return out.select("modelo_id", "status", F.coalesce("vocab_size", F.lit(-1)).alias("vocab_size"), F.round("coverage_sample", 5).alias("coverage_sample"), "kv_size_mb_est")


STOPS = ", ".join(f"('{lang}', '{w}')" for lang, ws in langid.STOP_WORDS.items() for w in ws)
# White space and word characters are spelled out: the two regex engines' classes differ.
WS = r"[ \t\n\r\f\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def detect_sql(source: str, key: str, text: str) -> str:
    return f"""(select s.key, coalesce(b.lang, '') as lang, coalesce(b.n / b.total, 0.0) as conf from (select {key} as key from {source}) s left join
(select key, arg_max(lang, (n, -ascii(lang), -ascii(lang[2]))) as lang, max(n) as n, sum(n) as total from
 (select key, stop.lang, count(*) as n from (select {key} as key, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+')) as w from {source}) t
  join (values {STOPS}) stop(lang, word) on stop.word = t.w group by key, stop.lang) group by key) b on s.key = b.key)"""


ART = r"""art as (select doc_id as eid, trim(split_part(text, chr(10), 1), E' \t\n\r\f\v') as title,
trim(case when contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) else '' end, E' \t\n\r\f\v') as abstract from documents)"""
DETECTED = f"""{ART}, counted as (select *, len(list_filter(regexp_split_to_array(abstract, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) as n_words from art),
ab as (select * from {detect_sql("counted where n_words >= 4", "eid", "abstract")}),
mid as (select c.*, coalesce(ab.lang, '') as lang_abstract, coalesce(ab.conf, 0.0) as conf_abstract from counted c left join ab on ab.key = c.eid),
ti as (select * from {detect_sql("mid where lang_abstract = 'en' and conf_abstract >= 0.6 and title <> ''", "eid", "title")}),
det as (select mid.*, coalesce(ti.lang, '') as lang_title, coalesce(ti.conf, 0.0) as conf_title,
  lang_abstract = 'en' and conf_abstract >= 0.6 and coalesce(ti.lang, '') = 'en' as ok from mid left join ti on ti.key = mid.eid)"""
TOKENS = f"{ART}, tok as (select eid, regexp_extract_all(abstract, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') as tokens from art)"
STOP_EN = ", ".join(f"'{w}'" for w in preprocess.STOP_WORDS)
REASON = f"""case when not regexp_full_match(w, '\\p{{L}}+') and not (regexp_matches(w, '[0-9]') and regexp_full_match(lower(w), '([a-z][0-9]{{1,2}}|[0-9]{{1,2}}[a-z]|[a-z]{{1,3}}_[0-9]{{1,2}})')) then 'no_alpha'
when lower(w) in ({STOP_EN}) then 'stopword'
when regexp_full_match(lower(w), '[a-z]{{1,2}}') and upper(w) <> w then 'sigla_corta' end"""
CORPUS = "corpus as (select doc_id as eid, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 2) as tokens from documents)"
VOCAB = f"{CORPUS}, word as (select eid, unnest(tokens) as word from corpus), vocab as (select word, count(*) as n from word group by word)"
VECTORS = f"{VOCAB}, wv as (select word, n, length(word) * 31 + ascii(word) * 7 + n % 97 as seed from vocab where n >= 5)"
MEANS = f"""{VECTORS}, hit as (select w.eid, count(v.word) / count(*) as r, {", ".join(f"avg((seed * {j}) % 101 - 50) as v{j}" for j in SHOWN)} from word w left join wv v on v.word = w.word group by w.eid),
mean as (select c.eid, round(coalesce(r, 0.0), 6) as coverage_ratio, {", ".join(f"round(cast(cast(coalesce(v{j}, 0.0) as float) as double), 3) as v{j}" for j in SHOWN)}, 200 as dim from corpus c left join hit on hit.eid = c.eid)"""
BIGRAMS = f"""{VOCAB}, pairs as (select p.a, p.b, count(*) as n_ab from (select unnest(list_zip(tokens[1:-2], tokens[2:])) as p from
  (select tokens, struct_pack(x := 1) as z from corpus where len(tokens) > 1)) q(p0), (select 1) one, lateral (select struct_pack(a := p0[1], b := p0[2])) r(p) group by 1, 2),
size as (select (select count(*) from vocab) + (select count(*) from pairs) as v),
big as (select a, b, n_ab, (n_ab - 5) / va.n / vb.n * size.v as score from pairs, size, vocab va, vocab vb where va.word = a and vb.word = b and n_ab > 5 and (n_ab - 5) / va.n / vb.n * size.v > 10)"""
# In a run of adjacent known pairs, the greedy merge takes every other one, from the first on.
MERGED = f"""{BIGRAMS}, pos as (select eid, i, tokens[i] as w, tokens[i + 1] as nx from (select eid, tokens, unnest(range(1, len(tokens) + 1)) as i from corpus)),
flag as (select pos.*, big.a is not null as k from pos left join big on big.a = w and big.b = nx),
run as (select *, sum(if(k, 0, 1)) over (partition by eid order by i) as g from flag),
mark as (select *, k and (row_number() over (partition by eid, g, k order by i) - 1) % 2 = 0 as m from run),
seen as (select *, coalesce(lag(m) over (partition by eid order by i), false) as gone from mark),
merged as (select eid, count(*) as n, string_agg(if(m, w || '_' || nx, w), ' ' order by i) as s from seen where not gone group by eid)"""

QUERIES = {
    f.__name__: f
    for f in (
        lang_detect, lang_filter_ok, lang_filter_rejected, lang_summary, compose_text, header_union, meta_clean, tokens_clean, discard_log, discard_summary, meta_token_filter, phrase_whitelist,
        bigram_scores, bigram_apply, bigram_apply_repeated_ids, vocab_thresholds, w2v_vocab, doc_coverage, doc_mean_vector, doc_mean_repeated_ids, coverage_sample, sample_docs, kv_size_mb, w2v_grid_scores, w2v_grid_search, w2v_train,
    )
}
SQL = {
    "lang_detect": f"select key as doc_id, lang, round(conf, 5) as conf from {detect_sql('documents', 'doc_id', 'text')}",
    "lang_filter_ok": f"with {DETECTED} select eid, lang_abstract, lang_title, md5(trim(title || '. ' || abstract, E' \\t\\n\\r\\f\\v')) as text_md5 from det where ok",
    "lang_filter_rejected": f"with {DETECTED} select eid, lang_abstract, lang_title from det where not ok",
    "lang_summary": f"""with {DETECTED}, named as (select if(lang_abstract = '', '(sin_deteccion)', lang_abstract) as a, if(lang_title = '', '(sin_deteccion)', lang_title) as t from det)
select idioma, cast(sum(a) as bigint) as abstract_count, cast(sum(t) as bigint) as titulo_count from (select a as idioma, 1 as a, 0 as t from named union all select t, 0, 1 from named) group by idioma
union all select 'TOTAL', count(*), count(*) from named""",
    "compose_text": r"""with raw as (select doc_id as eid, split_part(text, chr(10), 1) as title, case when contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) else '' end as abstract from documents)
select eid, md5(trim(title || '. ' || abstract, E' \t\n\r\f\v')) as text_md5, cast(len(list_filter(regexp_split_to_array(abstract, '[ \t\n\r\f]+'), lambda w: w <> '')) as bigint) as n_words from raw""",
    "header_union": """select cast(c_custkey as varchar) as eid, c_name as title, '' as country, c_mktsegment as venue, '' as origin from customer
union all select cast(s_suppkey as varchar), s_name, cast(s_nationkey as varchar), '', '' from supplier""",
    "meta_clean": r"""with t as (select doc_id, regexp_replace('Copyright 2020 ELSEVIER  ' || text || E' Tous droits RÉSERVÉS, Addison-Wesley\t',
'(?i)(copyright|©|all rights reserved|alle rechte vorbehalten|tous droits réservés|reproduction|photocopying|microfilming|presses universitaires|springer|verlag|wiley|elsevier|addison[- ]wesley|boca raton)', ' ', 'g') as x from documents)
select doc_id, md5(trim(regexp_replace(x, '[ \t\n\r\f]+', ' ', 'g'))) as text_md5 from t""",
    "tokens_clean": f"""with {TOKENS}, each as (select eid, i, tokens[i] as w from (select eid, tokens, unnest(range(1, len(tokens) + 1)) as i from tok))
select t.eid, cast(len(tokens) as bigint) as n_tokens, coalesce(k.n, 0) as n_kept, md5(coalesce(k.s, '')) as kept_md5 from tok t left join
(select eid, count(*) as n, string_agg(lower(w), ' ' order by i) as s from (select *, {REASON} as reason from each) where reason is null group by eid) k on k.eid = t.eid""",
    "discard_log": f"""with {TOKENS} select w as palabra, reason as motivo, count(*) as frecuencia from
(select w, {REASON} as reason from (select unnest(tokens) as w from tok)) where reason is not null group by 1, 2""",
    "discard_summary": f"""with {TOKENS} select reason as motivo, count(*) as frecuencia from
(select {REASON} as reason from (select unnest(tokens) as w from tok)) where reason is not null group by 1""",
    "meta_token_filter": "select p_partkey, p_name || ' pressure' as kept from part",
    "phrase_whitelist": """with t as (select p_partkey, p_name, lower(p_name) as low from part)
select p_partkey, trim((case when low = 'small ring' then 'small_ring gear r' when low like '% ring' then 'ring_gear ' || split_part(low, ' ', 1) || ' r' else low || ' gear r' end)) as tokens from t""",
    "bigram_scores": f"with {BIGRAMS} select a, b, n_ab, round(score, 4) as score from big",
    "bigram_apply": f"with {MERGED} select c.eid, coalesce(n, 0) as n_tokens, md5(coalesce(s, '')) as tokens_md5 from corpus c left join merged on merged.eid = c.eid",
    "bigram_apply_repeated_ids": f"with {MERGED} select c.eid % 100 as eid, coalesce(n, 0) as n_tokens, md5(coalesce(s, '')) as tokens_md5 from corpus c left join merged on merged.eid = c.eid",
    "vocab_thresholds": f"with {VOCAB}, t(min_count) as (values (1), (2), (3), (5), (8), (10)) select min_count, count(*) filter (n >= min_count) as kept, count(*) filter (n < min_count) as dropped from vocab, t group by min_count",
    "w2v_vocab": f"with {VOCAB} select word, n from vocab where n >= 2",
    "doc_coverage": f"""with {VECTORS}, hit as (select w.eid, count(wv.word) / count(*) as r from word w left join wv on wv.word = w.word group by w.eid)
select c.eid, round(coalesce(r, 0.0), 6) as coverage_ratio from corpus c left join hit on hit.eid = c.eid""",
    "doc_mean_vector": f"with {MEANS} select * from mean",
    "doc_mean_repeated_ids": f"with {MEANS} select eid % 100 as eid, * exclude (eid) from mean",
    "coverage_sample": f"""with {VECTORS}, pick as (select eid from corpus order by md5('42:' || cast(eid as varchar)), eid limit 5000),
hit as (select w.eid, count(wv.word) / count(*) as r from word w left join wv on wv.word = w.word where w.eid in (select eid from pick) group by w.eid) select round(avg(r), 6) as coverage_sample from hit""",
    "sample_docs": "select doc_id as eid, lang from documents order by md5('42:' || cast(doc_id as varchar)), doc_id limit 5000",
    "w2v_train": f"with {VOCAB} select word, 200 as dim from vocab where n >= 2",
    "w2v_grid_search": f"""with {VOCAB}, g(sg, min_count) as (values (1, 5), (0, 20)), pick as (select eid from corpus where len(tokens) > 0 and eid in (select eid from corpus order by md5('42:' || cast(eid as varchar)), eid limit 5000)),
size as (select min_count, sg, count(*) filter (n >= min_count) as k from vocab, g group by all),
hit as (select min_count, eid, count(*) filter (n >= min_count) / count(*) as r from word join vocab using (word), g where eid in (select eid from pick) group by all)
select 'w2v_d24_w4_m' || min_count || '_sg' || sg || '_e2_s42' as modelo_id, 'ok' as status, k as vocab_size, (select round(avg(r), 5) from hit where hit.min_count = size.min_count) as coverage_sample,
  round(k * 24 * 4 / 1048576.0, 2) as kv_size_mb_est from size union all select 'w2v_d24_w4_m5_sg7_e1_s42', 'error', -1, null, null""",
    "kv_size_mb": f"with {VOCAB} select count(*) as vocab_size, round(count(*) * 200 * 4 / 1048576.0, 2) as kv_size_mb_est from vocab",
    "w2v_grid_scores": f"""with {VECTORS}, grid(vector_size, w, min_count, sg, epochs) as (values (100, 5, 2, 1, 5), (200, 10, 3, 1, 12), (50, 5, 1, 1, 3)),
norm as (select avg(sqrt(list_sum(list_transform(range(1, 201), lambda j: ((seed * j) % 101 - 50) ** 2)))) as a from wv),
g as (select grid.*, count(*) filter (vocab.n >= min_count) as k from grid, vocab group by all)
select 'w2v_d' || vector_size || '_w' || w || '_m' || min_count || '_sg' || sg || '_e' || epochs || '_s42' as modelo_id, 42 as seed, k as vocab_size,
round(k * vector_size * 4 / 1048576.0, 2) as kv_size_mb_est, round(k * a * 1.5, 2) as score from g, norm""",
}
