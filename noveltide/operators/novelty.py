"""The semantic novelty index: log ratio of an article's summed similarity to later over earlier articles.

Similarity is ``(cos + 1) / 2``, so a pool's sum is ``(n + u . S) / 2`` with ``S`` the sum of the pool's unit vectors;
no pair of articles is ever formed.  Earlier and later are by (day, id), within a window of whole days on either side.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.config import NoveltyConfig
from noveltide.functions import vectors as V

DAYS = 365.25
#: Articles of a day that are summed in one task, about, and blocks of a day at most.
BLOCK, BLOCKS = 4096, 1000


def prepare(df: DataFrame, id_col: str = "eid", date_col: str = "cover_date", vec_col: str = "vector", tie_col: str | None = None) -> DataFrame:
    """``eid, cover_date, ord, tie, u``: dated articles with their day number and unit vector; others are left out.

    ``tie`` orders articles of one day and id: ``tie_col``, or a fingerprint of the vector.
    """
    date = F.coalesce(F.to_date(df[date_col]) if dict(df.dtypes)[date_col] != "string" else F.expr(f"try_cast(`{date_col}` as date)"))
    rows = df.select(df[id_col].alias("eid"), date.alias("cover_date"), df[vec_col].alias("v"), (df[tie_col] if tie_col else F.xxhash64(df[vec_col])).alias("tie")).where("cover_date is not null and v is not null")
    return rows.select("eid", "cover_date", F.datediff("cover_date", F.lit("1970-01-01").cast("date")).alias("ord"), "tie", V.unit(V.doubles(F.col("v")), NoveltyConfig.norm_floor).alias("u"))


def eligible(prepared: DataFrame, years: int = NoveltyConfig.years, rows: DataFrame | None = None) -> DataFrame:
    """Articles (or ``rows`` of articles) with a whole window before and after them: the window here is ``years`` of 365.25 days."""
    bounds = prepared.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    near = years * DAYS
    rows = prepared if rows is None else rows
    return rows.crossJoin(F.broadcast(bounds)).where((F.col("ord") >= F.col("lo") + near) & (F.col("ord") <= F.col("hi") - near)).drop("lo", "hi")


def day_frames(prepared: DataFrame, window: int) -> DataFrame:
    """Per day with articles: number and vector sum of the day's, the ``window`` earlier and the ``window`` later days' articles.

    Running totals over a calendar without gaps, whose differences are the frames' sums.  Only this table (days x
    dimensions, whatever the number of articles) is taken apart by dimension; dimension -1 counts.
    """
    total = prepared.groupBy("ord").agg(F.count("*").cast("double").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("s"))
    each = total.select("ord", F.posexplode(F.concat(F.array("n"), F.col("s"))).alias("k", "x"))
    span = prepared.agg((F.min("ord") - window - 1).alias("lo"), (F.max("ord") + window).alias("hi"))
    calendar = span.select(F.explode(F.sequence("lo", "hi")).alias("ord"))
    filled = calendar.crossJoin(each.select("k").distinct()).join(each, ["k", "ord"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    by_dim = Window.partitionBy("k").orderBy("ord")
    running = filled.withColumn("upto", F.sum("x").over(by_dim.rowsBetween(Window.unboundedPreceding, 0)))
    # The calendar has a row for each day, so the totals that a frame needs stand so many rows away.
    past = F.lag("upto", 1).over(by_dim) - F.lag("upto", window + 1).over(by_dim)
    future = F.lead("upto", window).over(by_dim) - F.col("upto")
    frames = running.select("k", "ord", "x", past.alias("past"), future.alias("future")).join(total.select("ord"), "ord", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("k", "x", "past", "future")))  # one item per dimension
    rows = frames.groupBy("ord").agg(ordered.alias("a"))
    return rows.select("ord", *[F.col(f"a.{c}").alias(f"day_{c}") for c in ("x", "past", "future")])


def in_blocks(prepared: DataFrame, block: int = BLOCK, most: int = BLOCKS) -> DataFrame:
    """``prepared`` with ``block``: the number of an article's block in its day, by (id, tie).

    A day's blocks begin at articles that a hash draws: one of ``block``, or of a larger number if the day would have more than about
    ``most`` blocks.  A day of few articles is one block.  The draw depends on the articles alone, so all branches of
    the plan agree on it.
    """
    key = F.struct("eid", "tie")
    sizes = prepared.groupBy("ord").agg(F.count("*").alias("size")).where(F.col("size") > block)
    drawn = prepared.select("ord", "eid", "tie").join(sizes, "ord").where(F.pmod(F.xxhash64("eid", "tie"), F.greatest(F.lit(block), F.ceil(F.col("size") / most))) == 0)
    cuts = drawn.groupBy("ord").agg(F.sort_array(F.collect_set(key)).alias("cuts"))
    number = F.coalesce(F.size(F.filter("cuts", lambda c: c <= key)), F.lit(0))
    return prepared.join(cuts, "ord", "left").withColumn("block", F.when(F.col("cuts").isNull(), 0).otherwise(number)).drop("cuts")


def pools(prepared: DataFrame, years: int, block: int = BLOCK) -> DataFrame:
    """``eid, ord, past_pool_size, future_pool_size, past_dot, future_dot``: sizes, and the dot products with the pools' sums.

    The pools' other days come from the day's frames.  Within the day, sums run in two levels: over the totals of the
    day's blocks, and over the articles of a block, so that a day of many articles is worked off by several tasks.
    Frames and block sums are joined before the articles meet them by (day, block); vectors stay whole, and an article is one row throughout.
    """
    days = day_frames(prepared, int(years * DAYS))
    rows = in_blocks(prepared, block)
    totals = rows.groupBy("ord", "block").agg(F.count("*").alias("n"), Summarizer.sum(array_to_vector("u")).alias("s"))
    before = Window.partitionBy("ord").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select("ord", "block", (F.sum("n").over(before) - F.col("n")).alias("ahead"), vector_to_array("s").alias("own_s"), vector_to_array(Summarizer.metrics("sum").summary(F.col("s")).over(before)["sum"]).alias("upto_s"))
    totals = totals.join(days, "ord")

    same = Window.partitionBy("ord", "block").orderBy("eid", "tie")
    upto = vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("u")).over(same.rowsBetween(Window.unboundedPreceding, 0))["sum"])
    rows = rows.select("eid", "ord", "block", "u", F.row_number().over(same).alias("place"), upto.alias("upto")).join(totals, ["ord", "block"])

    def sums(c: str) -> Column:  # without the count
        return F.slice(c, F.lit(2), F.size(c) - 1)

    own, place = V.dot(F.col("u"), F.col("u")), F.col("ahead") + F.col("place")
    within = F.when(F.col("place") > 1, V.dot(F.col("upto"), F.col("u")) - own).otherwise(0.0)
    earlier = within + F.when(F.col("ahead") > 0, V.dot(F.col("upto_s"), F.col("u")) - V.dot(F.col("own_s"), F.col("u"))).otherwise(0.0)
    return rows.select(
        "eid",
        "ord",
        (F.round(F.get("day_past", F.lit(0))).cast("long") + place - 1).alias("past_pool_size"),
        (F.round(F.get("day_future", F.lit(0)) + F.get("day_x", F.lit(0))).cast("long") - place).alias("future_pool_size"),
        (V.dot(sums("day_past"), F.col("u")) + earlier).alias("past_dot"),
        (V.dot(sums("day_future"), F.col("u")) + V.dot(sums("day_x"), F.col("u")) - earlier - own).alias("future_dot"),
    )


def index(df: DataFrame, years: int = NoveltyConfig.years, **cols: str) -> DataFrame:
    """``eid, ki_score, past_pool_size, future_pool_size`` of the eligible articles.

    Every row is an article of its own: an id that repeats has a score for each of its rows.
    """
    prepared = prepare(df, **cols)
    floor = F.lit(NoveltyConfig.sum_floor)

    def summed(n: str) -> Column:
        size = F.col(f"{n}_pool_size")
        return F.when(size > 0, F.greatest((size + F.col(f"{n}_dot")) / 2, floor)).otherwise(floor)

    scored = eligible(prepared, years, pools(prepared, years))
    return scored.select("eid", F.log(summed("future") / summed("past")).alias("ki_score"), "past_pool_size", "future_pool_size")


def with_metadata(meta: DataFrame, result: DataFrame, columns: tuple[str, ...] = ("eid", "title", "cover_date", "citedby_count", "doi")) -> DataFrame:
    """The index beside those of the metadata columns that are there; only scored articles.

    They meet by id: an id that repeats on both sides gives every combination.
    """
    return meta.select(*[c for c in columns if c in meta.columns]).join(result, "eid")
