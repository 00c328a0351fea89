"""Spelling variants by anagram hashing: words that differ by one inserted, deleted or replaced letter.

1. A word's anagram value is the sum of its letters' values, a letter's value being the fifth power of its place in the
   alphabet.  Two words that differ by one removed letter have values that differ by that letter's value; by one replaced
   letter, by the difference of two letters' values.  So each word is keyed by its value less each of its letters, and by
   its value itself: words that could be near have a key in common.
2. One edit leaves the first or the second half of both words as it is, so the halves are part of the keys: words that
   merely have the same letters do not meet, and no group holds more than what shares half its letters in order.
3. Pairs that meet are verified by their edit distance, and each is kept once.
4. A word's form is its most frequent near word, if that is frequent enough; roots are found by following forms, twice
   as far in each round.

Defined results: words are distinct and not null; a word without near words has ``n_near`` 0, no form, and itself as root; equal counts
give the word that is smaller in code-point order; letters outside the alphabet have value 0 (they are compared like any
other); an empty table gives an empty result.  Very long words are keyed by 64-bit hashes of their halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.llm.common import cut, discard

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a-z and the letters of the Latin-1 supplement.
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))
RUN = "[A-Za-zÀ-ÿ]+"
POWER = 5


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, word``: the maximal runs of letters of every text, A-Z lower-cased; null texts have none."""
    found = F.regexp_extract_all(F.coalesce(df[text_col].cast("string"), F.lit("")), F.lit(RUN), 0)
    rows = df.select(df[id_col].alias("id"), F.explode(found).alias("word"))
    return rows.select("id", F.when(F.col("word").rlike("[A-Z]"), F.translate("word", UPPER, LOWER)).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough; counts are combined before they are dealt out."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def power(place: Column) -> Column:
    out = place.cast("long")
    for _ in range(POWER - 1):
        out = out * place
    return out


def keyed(vocab: DataFrame) -> DataFrame:
    """``g, word, n, letter, back``: a row per key and half.  ``letter`` is the place in the alphabet of what the key
    leaves out, or null where it is the word's whole value (as if any letter were added)."""
    places = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    rows = vocab.select("word", "n", F.char_length("word").alias("m"), places.alias("places"))
    rows = rows.withColumn("value", F.aggregate("places", F.lit(0).cast("long"), lambda t, p: t + power(p)))
    left_out = F.explode(F.concat(F.array_distinct("places"), F.array(F.lit(None).cast("int"))))
    rows = rows.select("word", "n", "m", "value", left_out.alias("letter")).withColumn("key", F.col("value") - F.coalesce(power(F.col("letter")), F.lit(0)))
    # A word of m letters is compared with such of m and (as the shorter one) of m + 1; both are cut at the same place.
    longer = F.col("m") + F.col("letter").isNull().cast("int")
    first = F.floor((longer - 1) / 2).cast("int")
    halves = F.array(F.struct(F.lit(False).alias("back"), F.left("word", first).alias("half")), F.struct(F.lit(True).alias("back"), F.right("word", longer - 1 - first).alias("half")))
    rows = rows.select("word", "n", "letter", "key", longer.alias("longer"), F.explode(halves).alias("h"))
    return rows.select(F.xxhash64("key", "longer", "h.back", "h.half").alias("g"), "word", "n", "letter", F.col("h.back").alias("back"))


def merged(side: DataFrame) -> DataFrame:
    """A side that grows with the vocabulary is never broadcast: as a small file with many rows to an entry, Spark takes it for small."""
    return side.hint("merge")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """``a, na, b, nb``: each pair of near words once."""
    rows = keyed(vocab)
    left = rows.where("letter is not null").select("g", F.col("word").alias("a"), F.col("n").alias("na"), "letter", "back")
    right = rows.select("g", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("letter").alias("other"))
    # Words of equal value meet by every letter that they share; they can be near only by letters outside the alphabet.
    replaced = (F.col("a") < F.col("b")) & ((F.col("letter") != F.col("other")) | (F.col("letter") == 0))
    met = left.join(merged(right), "g").where(F.col("other").isNull() | replaced)
    # Pairs whose first halves agree as well have met by those.
    first = F.floor((F.char_length("a") - 1) / 2).cast("int")
    once = ~F.col("back") | (F.left("a", first) != F.left("b", first))
    return met.where(once).where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of rows ``word, form``: the end of each chain of forms."""
    reach = cut(forms.select("word", F.col("form").alias("up")), "reach")
    while True:
        above = reach.select(F.col("word").alias("up"), F.col("up").alias("next"))
        far = cut(reach.join(merged(above), "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "reach")
        discard(reach)
        reach = far.select("word", "up")
        if far.where("moved").isEmpty():
            return reach.select("word", F.col("up").alias("root"))


def variants(vocab: DataFrame, factor: float = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n``: the form has at least ``factor`` times the word's count."""
    vocab = cut(vocab, "vocabulary")
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    each = near_pairs(vocab).select(F.explode(ends).alias("e")).select("e.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    rows = vocab.join(merged(best), "word", "left")
    has = -F.col("top.m") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("top.other")).alias("form"), F.when(has, -F.col("top.m")).alias("form_n"))
    rows = cut(rows, "forms")
    out = rows.join(merged(roots(rows.where("form is not null"))), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
