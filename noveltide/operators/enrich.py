"""Flattening of search entries and enrichment from per-article records.

Some fields of a record are an object or a list of objects; they are read as raw JSON text and brought to an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide.config import EnrichConfig
from noveltide.functions.text import joined

AUTHORS = "array<struct<`@auid`:string,`preferred-name`:struct<`ce:indexed-name`:string>,affiliation:string>>"
LANGUAGE = "bibrecord struct<head:struct<`citation-info`:struct<`citation-language`:string>>>"
RECORD = (
    f"eid string, error string, `dc:description` string, `citedby-count` string, affiliations string, authors {AUTHORS}, "
    f"keywords string, `subject-areas` struct<`subject-area`:string>, item struct<bibrecord:struct<head:struct<`citation-info`:struct<`citation-language`:string>>>>"
)
#: A service's answer: its parts as JSON text, and what is read of two of them.
ANSWER_KEY = "abstracts-retrieval-response"
ANSWER = "struct<coredata:string,affiliation:string,authors:string,`subject-areas`:string,item:string>"
CORE = "`dc:description` string, `citedby-count` string"
ITEM = "bibrecord struct<head:struct<`citation-info`:struct<`author-keywords`:struct<`author-keyword`:string>>>>"
AFFILIATION = "struct<`@id`:string,affilname:string,`affiliation-name`:string>"
ENTRY = "eid string, `dc:title` string, `dc:creator` string, author array<struct<authid:string,authname:string>>, `prism:coverDate` string, `prism:doi` string, `citedby-count` string"


def flatten_entries(df: DataFrame, entry_col: str = "entry") -> DataFrame:
    """Nine text columns from search entries (structs of the ``ENTRY`` shape); missing values are empty."""
    e = F.col(entry_col)
    author = F.coalesce(e["author"], F.array().cast("array<struct<authid:string,authname:string>>"))

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return df.select(
        text(e["eid"]).alias("eid"),
        text(e["dc:title"]).alias("title"),
        text(e["dc:creator"]).alias("first_author_name"),
        text(F.get(author, F.lit(0))["authid"]).alias("first_author_id"),
        joined(F.transform(author, lambda a: a["authname"])).alias("all_authors"),
        joined(F.transform(author, lambda a: a["authid"])).alias("author_ids"),
        text(e["prism:coverDate"]).alias("cover_date"),
        text(e["prism:doi"]).alias("doi"),
        text(e["citedby-count"]).alias("cited_by"),
    )


def project(answer: Column, id_: Column) -> Column:
    """The parts of a service's answer (parsed as ``ANSWER``) that make a record, in the shape of ``RECORD``.

    A part of another shape than the service documents makes the answer an error.
    """
    core, item = F.from_json(answer["coredata"], CORE), F.from_json(answer["item"], ITEM)
    info = item["bibrecord"]["head"]["citation-info"]
    parts = [answer[c] for c in ("coredata", "authors", "subject-areas", "item")]
    odd = F.exists(F.array(*parts), lambda x: x.isNotNull() & (F.substring(F.ltrim(x), 1, 1) != "{"))
    kept = {
        "eid": id_.cast("string"),
        "error": F.when(odd, F.lit("a part of the answer is no object")),
        "dc:description": core["dc:description"],
        "citedby-count": core["citedby-count"],
        "affiliations": F.when(F.substring(F.ltrim(answer["affiliation"]), 1, 1) == "[", answer["affiliation"]),
        "authors": F.from_json(answer["authors"], f"author {AUTHORS}")["author"],
        "keywords": info["author-keywords"]["author-keyword"],
        "subject-areas": F.from_json(answer["subject-areas"], "`subject-area` string"),
        "item": F.from_json(answer["item"], LANGUAGE),
    }
    return F.struct(*[c.alias(name) for name, c in kept.items()])


def parse_record(df: DataFrame, json_col: str = "record", id_col: str = "eid") -> DataFrame:
    """``df`` with ``r``, the parsed record, and ``error``.  The text is a record, or a service's answer as it came."""
    answer = F.from_json(F.col(json_col), f"`{ANSWER_KEY}` {ANSWER}")[ANSWER_KEY]
    parsed = F.when(answer.isNotNull(), project(answer, F.col(id_col))).otherwise(F.from_json(F.col(json_col), RECORD))
    return df.withColumn("r", parsed).withColumn("error", F.when(F.col("r").isNull() | F.col("r.eid").isNull(), F.lit("unreadable record")).otherwise(F.col("r.error")))


def quarantine(records: DataFrame, id_col: str = "eid", json_col: str = "record") -> DataFrame:
    """``id, error`` of the records that cannot be merged."""
    return parse_record(records, json_col, id_col).where("error is not null").select(id_col, "error")


def as_list(raw: Column, item: str, single: bool = True) -> Column:
    """An array of ``item`` from the JSON text of a list or (if ``single``) of one object; anything else is empty."""
    none = F.array().cast(f"array<{item}>")
    head = F.substring(F.ltrim(raw), 1, 1)
    many = F.from_json(raw, f"array<{item}>")
    one = F.array(F.from_json(raw, item)) if single else none
    return F.coalesce(F.when(head == "[", many).when(head == "{", one), none)


def _full(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def author_names(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda a: a["preferred-name"]["ce:indexed-name"]), _full)


def author_ids(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda a: a["@auid"]), _full)


def author_affiliations(authors: Column) -> Column:
    """The affiliations of authors that have exactly one (an object; lists are skipped)."""
    own = F.filter(F.transform(authors, lambda a: a["affiliation"]), lambda x: F.substring(F.ltrim(x), 1, 1) == "{")
    return F.transform(own, lambda x: F.from_json(x, AFFILIATION))


def affiliation_name(a: Column) -> Column:
    return F.when(_full(a["affilname"]), a["affilname"]).when(_full(a["affiliation-name"]), a["affiliation-name"])


def resolve_affiliations(affiliations: Column, authors_affiliations: Column, nameless: str = EnrichConfig.nameless) -> Column:
    """Names per author: from the id's entry (the last with a name), else the author's own, else ``nameless``.

    Distinct in order of appearance, then trimmed, then blanks out; so trimming can bring equal names back.
    """

    def name(a: Column) -> Column:
        found = F.filter(affiliations, lambda x: _full(x["@id"]) & (x["@id"] == a["@id"]) & affiliation_name(x).isNotNull())
        return F.coalesce(affiliation_name(F.get(found, F.size(found) - 1)), affiliation_name(a), F.lit(nameless))

    names = F.array_distinct(F.transform(authors_affiliations, name))
    return F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"(?U)^\s+|\s+$", "")), lambda n: n != "")


def subject_areas(raw: Column, codes: tuple[int, int] = EnrichConfig.subject_codes) -> Column:
    """``code-name`` of the areas with a code in the range; a code that is no number is skipped."""
    items = as_list(raw, "struct<`@code`:string,`$`:string>")

    def code(s: Column) -> Column:
        digits = F.regexp_extract(s["@code"], r"^\s*([0-9]{1,9})\s*$", 1)
        return F.when(digits != "", digits.cast("int"))

    kept = F.filter(items, lambda s: code(s).between(*codes))
    return F.transform(kept, lambda s: F.concat(code(s).cast("string"), F.lit("-"), F.coalesce(s["$"], F.lit(""))))


def keywords(raw: Column) -> Column:
    """The ``$`` of each keyword object, and other items as they are."""
    items = as_list(raw, "string", single=False)
    single = F.when(F.substring(F.ltrim(raw), 1, 1) == "{", F.array(raw)).otherwise(items)
    return F.transform(single, lambda k: F.when(F.substring(F.ltrim(k), 1, 1) == "{", F.coalesce(F.from_json(k, "struct<`$`:string>")["$"], k)).otherwise(k))


def language(raw: Column) -> Column:
    return F.coalesce(F.get(as_list(raw, "struct<`@xml:lang`:string>"), F.lit(0))["@xml:lang"], F.lit(""))


def widen(parsed: DataFrame) -> DataFrame:
    """The twelve derived columns from ``r``."""
    authors = F.coalesce(F.col("r.authors"), F.from_json(F.lit("[]"), AUTHORS))
    df = parsed.withColumn("_own", author_affiliations(authors)).withColumn("_names", author_names(authors)).withColumn("_ids", author_ids(authors))
    listed = as_list(F.col("r.affiliations"), AFFILIATION, single=False)
    df = df.withColumn("_aff", listed).withColumn("_aff", F.when(F.size("_aff") == 0, F.col("_own")).otherwise(F.col("_aff")))
    df = df.withColumn("_affn", resolve_affiliations(F.col("_aff"), F.col("_own"))).withColumn("_sub", subject_areas(F.col("r.subject-areas.subject-area")))
    return df.withColumns(
        {
            "abstract": F.col("r.dc:description"),
            "citedby_count": F.col("r.citedby-count"),
            "keywords": joined(keywords(F.col("r.keywords"))),
            "num_authors": F.size("_names"),
            "num_affiliations": F.size("_affn"),
            "authors_full": joined(F.col("_names")),
            "authors_ids": joined(F.col("_ids")),
            "affiliations_full": joined(F.col("_affn")),
            "affiliations_ids": joined(F.transform("_aff", lambda a: a["@id"])),
            "subject_areas": joined(F.col("_sub")),
            "num_subdisciplinas": F.size("_sub"),
            "idioma": language(F.col("r.item.bibrecord.head.citation-info.citation-language")),
        }
    ).drop("_own", "_names", "_ids", "_aff", "_affn", "_sub", "r", "error")


def merge(raw: DataFrame, records: DataFrame, enriched: DataFrame | None = None, id_col: str = "eid", json_col: str = "record") -> DataFrame:
    """Raw rows joined to their records and widened; rows without a record, with an error, or already enriched are out."""
    rows = raw if enriched is None else raw.join(enriched.select(id_col).distinct(), id_col, "left_anti")
    both = rows.join(records.select(id_col, json_col), id_col)
    return widen(parse_record(both, json_col, id_col).where("error is null")).drop(json_col)
