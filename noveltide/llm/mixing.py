"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, permuted block indexes.

1. The words of each source's documents, in a pseudorandom order of the documents, are one sequence that is cut into
   blocks of ``block`` words (the last may be shorter).  Running sums are worked out inside buckets of documents and over
   the buckets' totals, so no task holds a source.
2. A source's weight gives its share of ``share`` times all words, at most ``most`` times its own; what it cannot take
   is shared again by weight.  The target says how many slots of the output a source fills.
3. Output shards have ``shard`` slots.  Each slot draws its source with the sources' shares of the slots as
   probabilities, so a shard's counts are multinomial.  The draws of a source beyond its target are drawn again among
   those that fall short: in total each source takes its target, rounded down to a word.
4. A source's k-th slot over all shards takes block ``p(k mod blocks)`` of its pass ``k div blocks``, where ``p`` is a
   permutation of the block numbers of that source and pass (swap-or-not rounds, right for any number of blocks).  A
   shorter last block ends each pass, and the last slot of a source is cut at its target.
5. Slots and the documents' pieces are joined by source and block number.

All draws are MD5 values of the seed and of what is drawn for: reruns agree, whatever the partitioning.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source, last in order; sources
with a null, missing or not positive weight take nothing; rows that repeat an id are documents of their own; rows that
are alike in id, source and text are told apart by their place alone; an empty table gives empty results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARD, SEED = 2048, 8192, "mix"
#: Rows of a source that share a bucket, about; the sources' shares of the slots are found by so many cells.
BUCKET, CELLS = 2000, 4096
ROUNDS = 24


def drawn(*parts) -> Column:
    """60 pseudorandom bits of the parts."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def permuted(x: Column, n: Column, *key) -> Column:
    """``x`` of 0 .. n - 1 under a permutation of these numbers: in each round, x changes places with its partner or not."""
    least = F.greatest(n, F.lit(1))

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(drawn(*key, "k", r) % least - x, least)
        return F.when(drawn(*key, "b", r, F.greatest(x, partner)) % 2 == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``id, source, size, h, f`` of every row: its words, its place in the order of its source, its text's fingerprint."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return df.select(df[id_col].alias("id"), df[source_col].cast("string").alias("source"), size.alias("size"), drawn(seed, df[id_col]).alias("h"), F.xxhash64(text).alias("f"))


def targets(sizes: DataFrame, weights: DataFrame | tuple[float, ...], share: float, most: float) -> DataFrame:
    """``s, source, rows, source_size, target``: a row per source.

    ``weights`` is a table ``source, weight``, or values that repeat over the sources in code-point order.  The sources
    that take ``most`` are the first in the order of what they could take over their weight, so one pass over that order
    finds them.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    totals = totals.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))  # a row per source
    if isinstance(weights, tuple):
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") - 1) % len(weights))
    else:
        given = weights.select(F.col("source").cast("string").alias("_source"), F.col("weight").cast("double").alias("_weight")).dropDuplicates(["_source"])
        totals, weight = totals.join(given, totals["source"].eqNullSafe(given["_source"]), "left"), F.greatest(F.coalesce("_weight", F.lit(0.0)), F.lit(0.0))
    rows = totals.select("s", "source", "rows", "source_size", weight.alias("w"), (most * F.col("source_size")).cast("double").alias("limit"))
    every, earlier = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.try_divide("limit", "w").asc_nulls_last(), "s").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    rows = rows.withColumn("all", F.sum("source_size").over(every) * F.lit(float(share)))
    left, weight_left = F.col("all") - F.coalesce(F.sum("limit").over(earlier), zero), F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), zero)
    rows = rows.withColumn("full", (F.col("w") > 0) & (F.col("limit") * weight_left <= left * F.col("w")))
    taken, rest = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(zero)).over(every), F.sum(F.when(F.col("full"), zero).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.coalesce(F.try_divide((F.col("all") - taken) * F.col("w"), rest), zero))
    return rows.select("s", "source", "rows", "source_size", target.alias("target"))


def quotas(sources: DataFrame, block: int) -> DataFrame:
    """What each source fills: ``blocks`` (``full`` of whole length) a pass, ``passes`` and ``rest`` words, ``quota`` slots from ``base`` on."""
    size, t = F.col("source_size"), F.floor("target").cast("long")
    out = sources.withColumn("full", F.floor(size / block).cast("long")).withColumn("blocks", F.ceil(size / block).cast("long"))
    out = out.withColumn("passes", F.when(size > 0, F.floor(F.try_divide(t, size))).otherwise(0).cast("long"))
    out = out.withColumn("rest", F.when(size > 0, t - F.col("passes") * size).otherwise(0).cast("long"))
    out = out.withColumn("quota", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long"))
    before = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("base", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def fill(sources: DataFrame, block: int, shard: int, seed: str) -> DataFrame:
    """``shard, slot, s, pass, block, words`` of every slot of the output."""
    spark = sources.sparkSession
    n = sources.agg(F.sum("quota").alias("n")).first().n or 0
    width = -(-max(n, 1) // CELLS)
    cells = sources.where("quota > 0").select("s", "base", "quota", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("quota") - 1) / width))).alias("cell"))
    slots = spark.range(n).select(F.floor(F.col("id") / shard).alias("shard"), (F.col("id") % shard).alias("slot"), (drawn(seed, "slot", F.col("id")) % max(n, 1)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where((F.col("u") >= F.col("base")) & (F.col("u") < F.col("base") + F.col("quota")))
    slots = cut(slots.select("shard", "slot", "s"), "draws")
    counts = slots.groupBy("shard", "s").agg(F.count("*").alias("n"))  # the multinomial counts of each shard
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "s").orderBy("slot")) - 1
    slots = slots.withColumn("own", own).join(starts, ["shard", "s"]).select("shard", "slot", "s", (F.col("start") + F.col("own")).alias("k"))

    met = sources.join(counts.groupBy("s").agg(F.sum("n").alias("drawn")), "s", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    earlier = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    over, lack = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    met = met.withColumn("over", over).withColumn("lack", lack).withColumn("overs", F.sum("over").over(Window.partitionBy(F.lit(0))))
    met = met.withColumn("over_base", F.coalesce(F.sum("over").over(earlier), F.lit(0))).withColumn("lack_base", F.coalesce(F.sum("lack").over(earlier), F.lit(0)))
    met = cut(met, "sources")
    lacks = met.where("lack > 0").select(F.col("s").alias("s2"), "drawn", "lack_base", F.explode(F.sequence(F.lit(0), F.col("lack") - 1)).alias("i"))
    lacks = lacks.select("s2", (F.col("drawn") + F.col("i")).alias("k2"), (F.col("lack_base") + F.col("i")).alias("j"))
    slots = slots.join(met.select("s", "quota", "over_base", "overs"), "s")
    again = slots.where("k >= quota").withColumn("j", permuted(F.col("over_base") + F.col("k") - F.col("quota"), F.col("overs"), seed, "again"))
    slots = slots.where("k < quota").select("shard", "slot", "s", "k").unionByName(again.join(lacks, "j").select("shard", "slot", F.col("s2").alias("s"), F.col("k2").alias("k")))

    slots = slots.join(met.select("s", "source_size", "full", "blocks", "passes", "rest"), "s")
    slots = slots.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).withColumn("i", F.col("k") % F.col("blocks"))
    number = F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.col("full"), seed, F.col("s"), F.col("pass"))).otherwise(F.col("full"))
    end = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    return slots.select("shard", "slot", "s", "pass", number.alias("block"), F.least(F.lit(block), end - F.col("i") * block, F.col("source_size") - F.col("i") * block).alias("words"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``s, id, size, f, start``: where each row with words stands in the sequence of its source."""
    named = sources.select("s", F.col("source").alias("_source"), F.ceil(F.col("rows") / BUCKET).alias("buckets"))
    rows = sizes.where("size > 0").join(named, sizes["source"].eqNullSafe(named["_source"]))
    # The bucket is the leading part of h: the order over buckets is the order by h, however many there are.
    rows = rows.select("s", "id", "size", "h", "f", F.least(F.floor(F.col("h") / F.lit(2.0**60) * F.col("buckets")), F.col("buckets") - 1).alias("bucket"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("s", "bucket").orderBy("h", "id", "size", "f").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(offsets, ["s", "bucket"])
    return rows.select("s", "id", "size", "f", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))


@dataclass
class Mix:
    """``sizes`` (a row per document), ``sources``, ``slots`` of the output, ``pieces`` (documents' parts of the blocks)."""

    sizes: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    block: int


def mix(df: DataFrame, weights: DataFrame | tuple[float, ...], *, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    sizes = cut(sized(df, id_col, text_col, source_col, seed), "sizes")
    sources = cut(quotas(targets(sizes, weights, share, most), block), "quotas")
    end = F.col("start") + F.col("size")
    rows = placed(sizes, sources).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    pieces = rows.select("s", "block", "id", "size", "f", "start", F.greatest("start", F.col("block") * block).alias("lo"), F.least(end, (F.col("block") + 1) * block).alias("hi"))
    return Mix(sizes, sources, fill(sources, block, shard, seed), pieces, block)


def used(m: Mix) -> DataFrame:
    """``shard, slot, s, words`` and a document's piece in it: ``id, f, start`` (of the document), ``lo, hi`` (places in the source)."""
    both = m.slots.join(m.pieces, ["s", "block"]).withColumn("hi", F.least("hi", F.col("block") * m.block + F.col("words")))
    return both.where("hi > lo").select("shard", "slot", "s", "words", "id", "size", "f", "start", "lo", "hi")


def taken(m: Mix) -> DataFrame:
    """``id, source, size, source_size, target, taken`` of every row."""
    uses = m.slots.groupBy("s", "block").agg(F.collect_list("words").alias("uses"))  # one for each pass
    each = F.aggregate("uses", F.lit(0).cast("long"), lambda t, w: t + F.greatest(F.least(F.col("hi"), F.col("block") * m.block + w) - F.col("lo"), F.lit(0)))
    parts = m.pieces.join(uses, ["s", "block"], "left").withColumn("taken", F.coalesce(each, F.lit(0)))
    # The place in the source tells rows apart that repeat an id.
    rows = parts.groupBy("s", "start", "id", "size").agg(F.sum("taken").alias("taken")).join(m.sources.select("s", "source", "source_size", "target"), "s")
    named = m.sources.select(F.col("source").alias("_source"), "source_size", "target")
    blank = m.sizes.where("size = 0").join(named, m.sizes["source"].eqNullSafe(named["_source"])).withColumn("taken", F.lit(0).cast("long"))
    columns = ["id", "source", "size", "source_size", "target", "taken"]
    return rows.select(*columns).unionByName(blank.select(*columns))


def texts(m: Mix, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``shard, slot, source, words, text`` of every slot: its documents' words in order, with a space between."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].alias("_id"), F.xxhash64(text).alias("_f"), text.alias("_text")).dropDuplicates(["_id", "_f"])
    rows = used(m).join(docs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("f") == F.col("_f")))
    part = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(WORD), 0), (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    slots = rows.groupBy("shard", "slot", "s", "words").agg(F.array_sort(F.collect_list(F.struct("lo", part.alias("part")))).alias("parts"))
    return slots.join(m.sources.select("s", "source"), "s").select("shard", "slot", "source", "words", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"))
