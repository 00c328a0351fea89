"""Language filter: detect, accept English abstracts with English titles, compose the text.

The detector is a function on a column that returns ``struct<lang, conf>``; the default scores stop words in plain SQL
functions, so that nothing has to be downloaded.  A model-backed detector can be given instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.config import TextConfig
from noveltide.functions.text import let, strip, word_count

# Frequent function words by language.
STOP_WORDS = {
    "de": "der die das und ist nicht ein eine den von zu mit auf für im dem des sich auch als".split(),
    "en": "the of and to in is that for it was on are as with be by this from at an".split(),
    "es": "el la los las de que y en un una por con para del se es su al lo como".split(),
    "fr": "le la les des et est une du dans pour que qui sur au par pas avec ce il ne".split(),
}

Detector = Callable[[Column], Column]


def stop_word_detector(text: Column) -> Column:
    """The language with most stop-word occurrences (ties: smallest code), with its share of all hits; none: ("", 0).

    The text is split once; what is left of it are the few words that any language counts.
    """
    langs = sorted(STOP_WORDS)
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    hits = F.filter(tokens, _in(sorted({w for words in STOP_WORDS.values() for w in words})))

    def counted(found: Column) -> Column:
        # Equal counts go to the first language, whose negative number is larger.
        each = F.array(*[F.struct(F.size(F.filter(found, _in(STOP_WORDS[lang]))).alias("n"), F.lit(-k).alias("k")) for k, lang in enumerate(langs)])
        return let(each, lambda c: F.struct(F.array_max(c).alias("best"), F.aggregate(c, F.lit(0), lambda t, x: t + x["n"]).alias("total")))

    def named(c: Column) -> Column:
        lang = F.element_at(F.array(*map(F.lit, langs)), 1 - c["best"]["k"])
        some = c["best"]["n"] > 0
        return F.struct(F.when(some, lang).otherwise("").alias("lang"), F.when(some, c["best"]["n"] / c["total"]).otherwise(0.0).cast("float").alias("conf"))

    return let(let(hits, counted), named)


def model_detector(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> Detector:
    """A detector by a model that is loaded once per worker and given lists of texts; null and empty texts are not asked for."""

    @F.arrow_udf("struct<lang:string,conf:float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for part in parts:
            texts = part.to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            found = dict(zip(some, model([texts[i] for i in some]) if some else [], strict=True))
            langs, confs = zip(*(found.get(i, ("", 0.0)) for i in range(len(texts))), strict=True) if texts else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(confs, pa.float32())], names=["lang", "conf"])

    return run


def _in(words: list[str]):
    return lambda t: t.isin(*words)


def detect(df: DataFrame, detector: Detector = stop_word_detector, cfg: TextConfig = TextConfig()) -> DataFrame:
    """Adds ``lang_abstract, conf_abstract, lang_title, conf_title``; empty and 0 where a text was not evaluated.

    Abstracts of at least four words are evaluated; titles (lower-cased) only where the abstract passed, so the costly
    second detection runs on few rows.  Both stand behind a generator: conditions on their results would otherwise be
    pushed below them, with a copy of the detector for each.
    """
    missing = {"title", "abstract"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    none = F.struct(F.lit("").alias("lang"), F.lit(0.0).cast("float").alias("conf"))
    other = [F.col(c) for c in df.columns if c not in ("title", "abstract")]
    order = [F.col(c) for c in df.columns]
    texts = F.struct(strip(F.col("title")).alias("title"), strip(F.col("abstract")).alias("abstract"))
    rows = df.select(*other, F.explode(F.array(texts)).alias("_x")).select(*other, "_x.*")
    valid = word_count(F.col("abstract")) >= cfg.least_words
    rows = rows.withColumn("_v", F.when(valid, F.col("abstract")))
    found = F.when(F.col("_v").isNotNull(), detector(F.col("_v"))).otherwise(none)
    rows = rows.select("*", F.explode(F.array(found)).alias("_a")).drop("_v")
    passed = (F.col("_a.lang") == cfg.target) & (F.col("_a.conf") >= F.lit(cfg.abstract_confidence).cast("float")) & (F.col("title") != "")
    rows = rows.withColumn("_v", F.when(passed, F.lower("title")))
    rows = rows.select("*", F.explode(F.array(F.when(F.col("_v").isNotNull(), detector(F.col("_v"))).otherwise(none))).alias("_t")).drop("_v")
    return rows.select(*order, F.col("_a.lang").alias("lang_abstract"), F.col("_a.conf").alias("conf_abstract"), F.col("_t.lang").alias("lang_title"), F.col("_t.conf").alias("conf_title"))


def accepted(cfg: TextConfig = TextConfig()) -> Column:
    ok = (F.col("lang_abstract") == cfg.target) & (F.col("conf_abstract") >= F.lit(cfg.abstract_confidence).cast("float")) & (F.col("lang_title") == cfg.target)
    return F.coalesce(ok, F.lit(False))


def compose(title: Column, abstract: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit(""))))


def split(detected: DataFrame, cfg: TextConfig = TextConfig()) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with their ``text``, and the others."""
    ok = accepted(cfg)
    return detected.where(ok).withColumn("text", compose(F.col("title"), F.col("abstract"))), detected.where(~ok)
