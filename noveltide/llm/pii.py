"""Personal data: base patterns, and terms that give protected entities away by co-occurrence.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers, each kind leftmost and without
overlaps.  Every distinct value found is a protected entity.  Over all documents, the terms (words) that stand in one
document with an entity are counted, and the share of the entity's information that a term discloses is its pointwise
mutual information with the entity over the entity's information content, ``ln(n_et N / (n_e n_t)) / ln(N / n_e)``.  An
``n_et`` below ``support`` is little evidence and is multiplied by ``n_et / support``, so rare entities are protected too.
In documents that hold the entity, terms at or above ``generalise`` are replaced by a broader term: a year by its decade,
another number by its size, a name, code or other word by its class.  Terms at or above ``remove`` are taken out of every
document, whether it holds the entity or not.  Base spans are replaced by the name of their kind.

DataFrame functions only.  Counts are of whole documents, over the whole table.  Terms are counted by 64-bit hash.

Defined results: null texts count as empty and have no spans; rows with the same id and text count as one document and
all get its result; a null id is an id like another; term spans that overlap base spans are dropped (base ones stay);
overlapping base spans of different kinds are all reported, and the text is replaced from left to right; in a corpus
where an entity is in every document its information is zero and no term discloses it; extra columns are kept, whatever
their names (``spans`` and ``clean`` are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.llm.common import cut, discard

# The kinds in their order, and their patterns.  Possessive repeats and the conditions on what stands
# before a match change no match; they keep long runs of characters from being tried again from each position.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": "[0-9][.][0-9]++[.][0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": "[+][0-9]"}
NOT_WORD = r"[^\p{L}\p{N}]+"
RUN = 128  # of running totals: so many are added up one by one
FOUND = "array<struct<kind:string,start:int,end:int,match:string>>"


@dataclass
class PiiParams:
    """``support``: from so many documents in which term and entity meet, their count is taken as it is."""

    support: int = 3
    generalise: float = 0.7
    remove: float = 0.95


def luhn(digits: Column) -> Column:
    size = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, fold, start: int) -> Column:
    """Of each item of an int array, the fold of all items before it.

    Items are folded in runs and runs among themselves, which keeps long arrays cheap.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(start), fold)

    def places(n: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)

    def spread(vs: Column) -> Column:
        runs = F.transform(places(F.ceil(F.size(vs) / RUN).cast("int")), lambda r: total(F.slice(vs, r * RUN + 1, F.lit(RUN))))
        before = let(runs, lambda rs: F.transform(places(F.size(rs)), lambda r: total(F.slice(rs, F.lit(1), r))))

        def one(at: Column):
            return lambda i: fold(F.get(at, F.floor(i / RUN).cast("int")), total(F.slice(vs, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)))

        return let(before, lambda b: F.transform(places(F.size(vs)), one(b)))

    return let(values, spread)


def located(text: Column, pattern: Column, kind: str) -> Column:
    """Array of (kind, start, end, match) of the pattern's matches; the gaps between them tell where they are."""

    def both(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.char_length)
        return let(gaps, lambda g: F.zip_with(m, starts(m, g), item))

    def starts(m: Column, g: Column) -> Column:
        # From one match's start to the next's: its own length and that of the gap behind it.
        steps = F.transform(m, lambda x, i: F.char_length(x) + F.get(g, i + 1))
        return F.transform(running(steps, lambda a, b: a + b, 0), lambda s: s + F.get(g, 0))

    def item(m: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("match"))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, both(m)).otherwise(F.array().cast(FOUND)))


def base_spans(text: Column) -> Column:
    """Array of the valid spans of all kinds, in the order of the kinds."""

    def of(kind: str, pattern: str) -> Column:
        spans = F.filter(located(text, F.lit(pattern), kind), lambda s: valid(kind, s["match"]))
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(FOUND))

    return F.concat(*[of(k, p) for k, p in KINDS.items()])


def hinted(text: Column) -> Column:
    out = F.lit(False)
    for hint in HINTS.values():
        out = out | text.rlike(hint)
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (the columns to keep), ``_id``, ``_text``, ``_th``: inside, nothing can clash with a column of the input."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    return df.select(F.struct(*[df[c] for c in df.columns if c not in ("spans", "clean")]).alias("_row"), df[id_col].alias("_id"), text.alias("_text")).withColumn("_th", F.xxhash64("_text"))


def holders(docs: DataFrame) -> DataFrame:
    """``_id, _th, base, words``: the documents with base spans, their spans and their distinct words."""
    # Behind a generator, so that the condition does not have the spans worked out twice.
    rows = docs.where(hinted(F.col("_text"))).select("_id", "_th", "_text", F.explode(F.array(base_spans(F.col("_text")))).alias("base"))
    rows = rows.where(F.size("base") > 0)
    return cut(rows.select("_id", "_th", "base", F.array_distinct(words(F.col("_text"))).alias("words")).dropDuplicates(["_id", "_th"]), "pii-base")


def mentions(base: DataFrame) -> DataFrame:
    """``_id, _th, entity, n_e, word, term``: the distinct terms that meet each entity in each document.

    Entities of one document only that stand in the same one have the same counts, and go as one.
    """
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["match"]))))
    held = base.select("_id", "_th", F.explode(entities).alias("entity"))
    counts = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    alone = F.when(F.col("n_e") == 1, F.xxhash64("_id", "_th", F.lit("alone"))).otherwise(F.col("entity"))
    held = held.join(counts, "entity").select(F.col("_id").alias("_id2"), F.col("_th").alias("_th2"), alone.alias("entity"), "n_e").distinct()
    same = base["_id"].eqNullSafe(held["_id2"]) & (base["_th"] == held["_th2"])
    return base.join(held, same).select("_id", "_th", "entity", "n_e", F.explode("words").alias("word")).withColumn("term", F.xxhash64("word"))


def disclosing(docs: DataFrame, found: DataFrame, p: PiiParams) -> DataFrame:
    """``entity, term, share`` of the terms that disclose enough of an entity."""
    n = docs.select("_id", "_th").distinct().count()
    met = found.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_e") < n)
    terms = F.array_distinct(F.transform(F.split(F.lower("_text"), NOT_WORD), lambda w: F.xxhash64(w)))
    in_docs = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    both = met.join(in_docs, "term")
    information = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    sure = F.col("n_et") * F.least(F.lit(1.0), F.col("n_et") / F.lit(float(p.support)))
    # Repeated rows can make a term's count larger than the documents' number; they count once elsewhere.
    mutual = F.log(sure * F.lit(float(max(n, 1))) / (F.col("n_e") * F.greatest("n_t", "n_et")))
    shares = both.select("entity", "term", (mutual / information).alias("share"))
    return shares.where(F.col("share") >= p.generalise)


def told(docs: DataFrame, base: DataFrame, p: PiiParams) -> DataFrame:
    """``_id2, _th2, base, terms``: the spans and the disclosing terms of each document that has some of either."""
    found = mentions(base)
    shares = cut(disclosing(docs, found, p), "pii-terms")
    near = found.join(shares, ["entity", "term"]).select("_id", "_th", "word", (F.col("share") >= p.remove).alias("gone"))
    # Written on their own, these are mostly few enough to be sent to all, so that no text is dealt out for them.
    hidden = cut(shares.where(F.col("share") >= p.remove).select("term").distinct(), "pii-hidden")
    if not hidden.isEmpty():
        every = docs.select("_id", "_th", F.explode(F.array_distinct(words(F.col("_text")))).alias("word")).withColumn("term", F.xxhash64("word"))
        near = near.unionByName(every.join(hidden, "term", "left_semi").select("_id", "_th", "word", F.lit(True).alias("gone")))
    near = near.groupBy("_id", "_th", "word").agg(F.max("gone").alias("gone"))
    terms = near.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("word", "gone"))).alias("terms"))  # bounded by the document
    sides = base.select("_id", "_th", "base", F.lit(None).cast("array<struct<word:string,gone:boolean>>").alias("terms"))
    sides = sides.unionByName(terms.select("_id", "_th", F.lit(None).cast(FOUND).alias("base"), "terms"))
    merged = sides.groupBy("_id", "_th").agg(F.any_value("base", True).alias("base"), F.any_value("terms", True).alias("terms"))
    out = cut(merged.withColumnsRenamed({"_id": "_id2", "_th": "_th2"}), "pii-told")
    discard(shares, hidden, base)
    return out


def broader(term: Column) -> Column:
    """A broader term: the decade of a year, the size of another number, else the class of word."""
    size = F.char_length(term)
    return (
        F.when(term.rlike("^(1[5-9]|20)[0-9]{2}$"), F.concat(F.substring(term, 1, 3), F.lit("0s")))
        .when(term.rlike("^[0-9]+$"), F.concat(F.lit("[NUMBER OF "), size.cast("string"), F.when(size == 1, " DIGIT]").otherwise(" DIGITS]")))
        .when(term.rlike(r"\p{N}"), F.lit("[CODE]"))
        .when(term.rlike(r"^\p{Lu}\p{Ll}"), F.lit("[NAME]"))
        .otherwise(F.lit("[TERM]"))
    )


def sanitise(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: PiiParams | None = None) -> DataFrame:
    """``df`` plus ``spans`` (array of kind, start, end, action; base kinds in their order, then terms) and ``clean``.

    ``clean`` is the text with the spans replaced or removed.
    """
    p = params or PiiParams()
    docs = keyed(df, id_col, text_col)
    marks = told(docs, holders(docs), p)
    same = docs["_id"].eqNullSafe(marks["_id2"]) & (docs["_th"] == marks["_th2"])
    return finish(docs.join(marks, same, "left")).select("_row.*", "spans", "clean")


def finish(df: DataFrame) -> DataFrame:
    """All spans and the clean text from ``_text``, ``base`` and ``terms``."""
    base, terms, text = F.coalesce("base", F.array().cast(FOUND)), F.coalesce("terms", F.array().cast("array<struct<word:string,gone:boolean>>")), F.col("_text")
    listed = F.array_join(F.transform(terms, lambda t: t["word"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{N}])"))
    found = F.when(F.size(terms) > 0, located(text, pattern, "term")).otherwise(F.array().cast(FOUND))
    apart = let(base, lambda e: F.filter(found, lambda t: ~F.exists(e, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    gone = F.transform(F.filter(terms, lambda t: t["gone"]), lambda t: t["word"])

    def span(s: Column, action: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), action.alias("action"), s["match"].alias("match"))

    def acted(s: Column) -> Column:
        return span(s, F.when(F.array_contains(gone, F.lower(s["match"])), "remove").otherwise("generalise"))

    every = F.concat(F.transform(base, lambda s: span(s, F.lit("replace"))), F.transform(apart, acted))
    some = (F.size(F.coalesce("base", F.array())) > 0) | (F.size(F.coalesce("terms", F.array())) > 0)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,action:string,match:string>>")
    df = df.select("_row", "_text", F.explode(F.array(F.when(some, every).otherwise(none))).alias("_all"))
    order = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action"), s["match"].alias("match"))))

    def replaced(s: Column) -> Column:
        return F.when(s["action"] == "remove", "").when(s["action"] == "generalise", broader(s["match"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def cleaned(spans: Column) -> Column:
        # Spans that begin before the end of an earlier one go; text between is cut out of fixed-width code points.
        upto = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
        free = let(upto, lambda u: F.filter(spans, lambda s, i: s["start"] >= F.get(u, i)))
        return let(free, joined)

    def joined(free: Column) -> Column:
        wide = F.encode("_text", "UTF-32")

        def gap(w: Column, begin: Column, end: Column) -> Column:
            return F.decode(F.substring(w, 4 * begin + 1, 4 * (end - begin)), "UTF-32")

        def pieces(w: Column) -> Column:
            each = F.transform(free, lambda s, i: F.concat(gap(w, F.when(i == 0, F.lit(0)).otherwise(F.get(free, i - 1)["end"]), s["start"]), replaced(s)))
            rest = gap(w, F.get(free, F.size(free) - 1)["end"], F.char_length("_text"))
            return F.concat(F.array_join(each, ""), rest)

        return let(wide, pieces)

    shown = F.transform("_all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("action")))
    return df.select("_row", shown.alias("spans"), F.when(F.size("_all") > 0, let(order, cleaned)).otherwise(F.col("_text")).alias("clean"))
