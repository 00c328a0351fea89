"""Text cleaning, token rules and discard statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.functions.rows import row_key
from noveltide.functions.text import let, squeeze, strip

# publishers' boilerplate, and tokens that stem from it.
BOILERPLATE = (
    "copyright", "©", "all rights reserved", "alle rechte vorbehalten", "tous droits réservés",
    "reproduction", "photocopying", "microfilming", "presses universitaires",
    "springer", "verlag", "wiley", "elsevier", "addison[- ]wesley", "boca raton",
)
BAD_TOKENS = (
    "copyright", "all_rights", "rights_reserved", "alle_rechte", "rechte_vorbehalten", "tous_droits", "réservés",
    "microfilm", "wiley", "springer", "elsevier", "verlag", "addison_wesley", "boca_raton", "press",
)
BAD_PARTS = ("wiley_vch",)
# English stop words of the default tokenizer.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "not but they their we our you your i she her his them which who whom what when where how all any both each "
    "few more most other some such no nor only own same so than too very can just should now do does did been being have had"
).split()
MATH_TOKEN = r"^([a-z][0-9]{1,2}|[0-9]{1,2}[a-z]|[a-z]{1,3}_[0-9]{1,2})$"


def clean_boilerplate(text: Column) -> Column:
    """Publishers' phrases out (in any case, accents included), white space squeezed."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), "(?iu)(" + "|".join(BOILERPLATE) + ")", " "))


def is_meta_token(token: Column) -> Column:
    low = F.lower(token)
    out = low.isin(*BAD_TOKENS)
    for part in BAD_PARTS:
        out = out | F.contains(low, F.lit(part))
    return out


def drop_meta_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_meta_token(t))


def tokenize(text: Column) -> Column:
    """Words (letters, digits, inner underscores) and single other characters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def lemma(token: Column) -> Column:
    """The default lemma: the lower-case token."""
    return F.lower(token)


def whitelist(df: DataFrame) -> DataFrame:
    """``phrase`` (lower-case, trimmed) of the column ``palabra``, or else of the first column."""
    c = "palabra" if "palabra" in df.columns else df.columns[0]
    return df.select(F.lower(F.trim(F.col(c).cast("string"))).alias("phrase")).where("phrase <> ''").distinct()


def is_allowed(word: Column, allowed: list[str] | None) -> Column:
    """Whether a lower-case word is among the white-listed ones (looked up by hash, however many there are)."""
    return word.isin(*allowed) if allowed else F.lit(False)


def discard_reason(token: Column, allowed: list[str] | None = None) -> Column:
    """Why a token goes, or null if it stays.

    Rules in their order: not alphabetic (unless allowed or a mathematical symbol such as ``x2``), a stop word, one or
    two letters that are not upper-case.  ``allowed`` are the white-listed words.
    """
    low = F.lower(token)
    white = is_allowed(low, allowed)
    alphabetic = token.rlike(r"^\p{L}+$")
    math = token.rlike("[0-9]") & low.rlike(MATH_TOKEN)
    short = low.rlike("^[a-z]{1,2}$") & ~white & (F.upper(token) != token)
    return F.when(~alphabetic & ~white & ~math, "no_alpha").when(low.isin(*STOP_WORDS), "stopword").when(short, "sigla_corta")


def judged(tokens: Column, allowed: list[str] | None = None) -> Column:
    """Array of (word, reason, keep) per token: white-listed tokens stay whatever the reason."""

    def one(t: Column) -> Column:
        reason = discard_reason(t, allowed)
        white = is_allowed(F.lower(t), allowed)
        return F.struct(t.alias("word"), reason.alias("reason"), (reason.isNull() | white).alias("keep"))

    return F.transform(tokens, one)


def kept_lemmas(tokens: Column, allowed: list[str] | None = None, lemmatize: Callable[[Column], Column] = lemma) -> Column:
    return F.filter(F.transform(F.filter(judged(tokens, allowed), lambda x: x["keep"]), lambda x: lemmatize(x["word"])), lambda w: w != "")


SPAN = "array<struct<neg:int,at:int,n:int,phrase:string>>"


def anchors(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """``w, shift, words, n, phrase``: the multi-word entries of ``phrase``, each by its rarest word and that word's place.

    ``rows`` (``_low``: lower-case tokens) are counted for the phrases' words alone.  A phrase of which a word does not
    occur is left out.
    """
    many = phrases.select(F.split(F.lower(F.trim(F.regexp_replace("phrase", "_", " "))), " +").alias("words")).where(F.size("words") > 1).distinct()
    each = many.select("words", F.posexplode("words").alias("shift", "w"))
    counts = rows.select(F.explode("_low").alias("w")).join(F.broadcast(each.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count("*").alias("c"))
    rarest = each.join(counts, "w", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "shift", "w")).alias("r")).where("r.c > 0")
    return rarest.select("r.w", "r.shift", "words", F.size("words").alias("n"), F.array_join("words", "_").alias("phrase"))


def with_phrases(df: DataFrame, phrases: DataFrame, id_col: str = "eid", tokens_col: str = "tokens") -> DataFrame:
    """``df`` with ``_phrases`` (white-listed phrases found, joined by ``_``, in order) and ``_rest`` (the tokens outside).

    Longer phrases come first, and they do not overlap; matching ignores case.  Phrases meet the tokens by an equality
    join on their rarest word, so the list may be long and its phrases may begin with frequent words; only what meets is
    compared with the whole phrase.  The list, which people write, goes to the tokens: dealt out by word, all tokens of a
    frequent word would meet in one task.
    """
    rows = df.withColumn("_low", F.transform(tokens_col, F.lower)).withColumn("_row", row_key(id_col, tokens_col))
    met = rows.select("_row", F.posexplode("_low").alias("at", "w")).join(F.broadcast(anchors(rows, phrases)), "w").withColumn("at", F.col("at") - F.col("shift")).where("at >= 0").drop("w", "shift")
    met = met.join(rows.select("_row", "_low"), "_row").where(F.slice("_low", F.col("at") + 1, F.col("n")) == F.col("words"))
    spans = F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("neg"), "at", "n", "phrase"))).alias("_spans")
    rows = rows.drop("_low").join(met.groupBy("_row").agg(spans), "_row", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(SPAN)))

    def take(chosen: Column, s: Column) -> Column:
        free = ~F.exists(chosen, lambda o: (s["at"] < o["at"] + o["n"]) & (o["at"] < s["at"] + s["n"]))
        return F.when(free, F.array_append(chosen, s)).otherwise(chosen)

    chosen = F.aggregate("_spans", F.array().cast(SPAN), take)
    placed = F.array_sort(F.transform(chosen, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["phrase"].alias("phrase"))))

    def outside(p: Column) -> Column:
        def between(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(p, k - 1)["at"] + F.get(p, k - 1)["n"])
            end = F.when(k < F.size(p), F.get(p, k)["at"]).otherwise(F.size(tokens_col))
            return F.slice(tokens_col, begin + 1, end - begin)

        return F.struct(F.transform(p, lambda s: s["phrase"]).alias("phrases"), F.flatten(F.transform(F.sequence(F.lit(0), F.size(p)), between)).alias("rest"))

    return rows.withColumn("_parts", let(placed, outside)).select(*df.columns, F.col("_parts.phrases").alias("_phrases"), F.col("_parts.rest").alias("_rest"))


def cleaned(parted: DataFrame, tokens_col: str = "tokens", allowed: list[str] | None = None, lemmatize: Callable[[Column], Column] = lemma) -> DataFrame:
    """The rows of ``with_phrases`` with their tokens cleaned: phrases before all other kept lemmas."""
    return parted.withColumn(tokens_col, F.concat("_phrases", kept_lemmas(F.col("_rest"), allowed, lemmatize))).drop("_phrases", "_rest")


def phrases_first(df: DataFrame, phrases: DataFrame, id_col: str = "eid", tokens_col: str = "tokens", allowed: list[str] | None = None, lemmatize: Callable[[Column], Column] = lemma) -> DataFrame:
    return cleaned(with_phrases(df, phrases, id_col, tokens_col), tokens_col, allowed, lemmatize)


def discard_log(df: DataFrame, tokens_col: str = "tokens", allowed: list[str] | None = None) -> DataFrame:
    """``palabra, motivo, frecuencia`` of the tokens that go."""
    each = df.select(F.explode(F.filter(judged(F.col(tokens_col), allowed), lambda x: ~x["keep"])).alias("x"))
    return each.groupBy(F.col("x.word").alias("palabra"), F.col("x.reason").alias("motivo")).agg(F.count("*").alias("frecuencia"))


def discard_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("motivo").agg(F.sum("frecuencia").alias("frecuencia"))


def with_text(df: DataFrame) -> DataFrame:
    """``df`` with ``text``: its own, or title and abstract (missing parts count as empty)."""
    if "text" in df.columns:
        return df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return df.withColumn("text", strip(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))))


def dated(df: DataFrame, date_col: str = "cover_date") -> DataFrame:
    """Rows with a date that can be read, as dates."""
    return df.withColumn(date_col, F.expr(f"try_cast(`{date_col}` as date)")).where(F.col(date_col).isNotNull())
