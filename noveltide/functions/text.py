"""Text functions on columns.  Java's \\s and (?i) are ASCII-only, so the patterns ask for Unicode where it matters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(c, SPACE, " "))


def word_count(c: Column) -> Column:
    """Number of words between white space; 0 for blank and null texts."""
    return F.regexp_count(F.coalesce(c.cast("string"), F.lit("")), F.lit(r"(?U)\S++"))


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), SPACE), lambda w: w != "")


@lru_cache(maxsize=1)
def _nfkc():
    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in s.to_pylist()], pa.string())

    return run


def nfkc(c: Column) -> Column:
    """Compatibility composition (texts in the JVM hold no characters that cannot be encoded).  Spark has no built-in for it."""
    return _nfkc()(c)


def hms(seconds: Column) -> Column:
    """``"{h}h {m}m {s}s"`` of a number of seconds."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%dh %dm %ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_file(year: Column, stem: str = "articles") -> Column:
    d = decade(year)
    return F.format_string(f"{stem}_%d_%d.csv", d, d + 9)


def joined(items: Column, sep: str = "; ") -> Column:
    """Joins an array; null items count as empty (array_join would drop them), a null array gives an empty text."""
    return F.coalesce(F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit(""))), sep), F.lit(""))
