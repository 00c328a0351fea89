"""URL filters with dated lists: validity intervals and an as-of join.

Dated list entries (add or remove a pattern on a day) become validity intervals per list and pattern.  Every capture is
evaluated against the entries active when it was fetched.  A pattern is a domain (which covers its subdomains) or an IP
address (which covers itself; IPv6 in brackets), with a path (which covers the paths below it) or without; a scheme,
user, port, query, final dot of the host and final slashes in it do not count.  A capture is looked up by the keys that its URL can match, so
the work is an equality join on the key with the interval as a condition; equal captures are evaluated once, and the
join back to all captures has a unique key on one side, so that a hot host can be split by adaptive execution.

DataFrame functions only.  Defined results: a null or malformed URL, or a null fetch day, matches nothing and is kept;
repeated captures each get their row; entries with a null part are ignored; repeated or contradicting entries of a day
count once, removal last; extra columns of the captures are kept (clashing names are replaced by the results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HOST = r"(\[[0-9A-Fa-f:.%]+\]|[^/?#:@\[\]]+?)\.?(?::[0-9]*)?"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if the URL has none."""
    return F.lower(F.regexp_extract(url, rf"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?{HOST}(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def normal(pattern: Column) -> Column:
    """The host of a pattern with the non-empty segments of its path; empty if it has no host."""
    url = F.regexp_replace(F.trim(pattern), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?", "x://")
    path = F.lower(F.array_join(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), "/"))
    host = host_of(url)
    return F.when(host == "", "").when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, valid_from, valid_to`` (exclusive; null: still active) from ``list, pattern, day, action``.

    ``action`` is ``add`` or ``remove``.  The entries of one pattern are its history, a bounded handful of rows.
    """
    clean = entries.select("list", normal(F.col("pattern")).alias("pattern"), F.col("day").cast("date").alias("day"), F.lower("action").alias("action"))
    clean = clean.dropna().where("action in ('add', 'remove') and pattern <> ''")
    daily = clean.groupBy("list", "pattern", "day").agg(F.max("action").alias("action"))  # 'remove' sorts last
    w = Window.partitionBy("list", "pattern").orderBy("day")
    turns = daily.withColumn("before", F.lag("action").over(w)).where("before is null or before <> action")
    ends = turns.withColumn("valid_to", F.lead("day").over(w))
    return ends.where("action = 'add'").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def keys(url: Column, depth: int) -> Column:
    """The patterns that could match a URL: each domain suffix, and each with up to ``depth`` path segments."""
    host, segments = host_of(url), F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    address = host.rlike(r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$")  # has no domain above it
    labels = F.when(address, F.array(host)).otherwise(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(depth), F.size(segments))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.lower(F.array_join(F.slice(segments, F.lit(1), k), "/")))),
    )
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))
    return F.when(host != "", both).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """``captures`` with ``lists`` (sorted names of the lists active for it, comma-joined), ``patterns`` and ``blocked``."""
    active = intervals(entries)
    depth = active.agg(F.max(F.size(F.split("pattern", "/")) - 1).alias("d")).first().d or 0
    own = captures.select(*[captures[c] for c in captures.columns if c not in ("lists", "patterns", "blocked")])
    distinct = own.select(F.col(url_col).alias("_url"), F.col(fetched_col).cast("date").alias("_day")).where("_url is not null and _day is not null").distinct()
    hits = (
        distinct.select("_url", "_day", F.explode(F.array_distinct(keys(F.col("_url"), depth))).alias("pattern"))
        .join(active, "pattern")
        .where("_day >= valid_from and (valid_to is null or _day < valid_to)")
        .groupBy("_url", "_day")
        .agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"))
    )
    joined = own.join(hits, (own[url_col] == hits["_url"]) & (own[fetched_col].cast("date") == hits["_day"]), "left")
    return joined.select(
        *[own[c] for c in own.columns],
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("patterns", F.lit("")).alias("patterns"),
        F.col("lists").isNotNull().alias("blocked"),
    )
