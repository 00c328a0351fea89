"""Bigram learning and application."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from noveltide.config import TextConfig
from noveltide.sources.scratch import Scratch

#: Tokens that a task counts at once, rows of a batch that it returns, and tokens of a shard.
BLOCK, RETURNED, SHARD_TOKENS = 2_000_000, 50_000, 4_000_000
COUNTED = "pair boolean, a string, b string, n long"


def neighbours(tokens: Column) -> Column:
    """Array of (a, b) of adjacent tokens."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def count_block(lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """``pair, a, b, n`` of the words (``pair`` false, ``b`` null) and the neighbours of some token arrays."""
    tokens = pa.chunked_array([x.flatten() for x in lists]).combine_chunks()
    if not len(tokens):
        return
    coded = tokens.dictionary_encode(null_encoding="encode")
    words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(sum(map(len, lists))), np.concatenate([pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False) for x in lists]))
    yield from counted(words, None, np.arange(len(words)), np.bincount(at, minlength=len(words)))
    pairs, n = np.unique((at[:-1] * len(words) + at[1:])[doc[:-1] == doc[1:]], return_counts=True)
    for k in range(0, len(pairs), RETURNED):
        yield from counted(words, pairs[k : k + RETURNED] % len(words), pairs[k : k + RETURNED] // len(words), n[k : k + RETURNED])


def counted(words: pa.Array, b: np.ndarray | None, a: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    second = pa.nulls(len(a), words.type) if b is None else words.take(pa.array(b))
    yield pa.record_batch([pa.array(np.full(len(a), b is not None)), words.take(pa.array(a)), second, pa.array(n.astype(np.int64))], names=["pair", "a", "b", "n"])


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0))
        size += len(held[-1].flatten())
        if size >= BLOCK:
            yield from count_block(held)
            held, size = [], 0
    if held:
        yield from count_block(held)


def learn(df: DataFrame, tokens_col: str = "tokens", min_count: int = TextConfig.bigram_min_count, threshold: float = TextConfig.bigram_threshold) -> DataFrame:
    """``a, b, n_ab, score`` of the bigrams with ``(n_ab - min_count) / n_a / n_b * |V| > threshold``.

    |V| counts the distinct words and the distinct pairs together.  The texts are read once: tasks count words and pairs of
    a block together, and their counts are added up in one shuffle.  Only what occurs more than ``min_count`` times is
    kept, the rest is counted.  The bigrams are a written table.
    """
    each = df.select(tokens_col).mapInArrow(count, COUNTED).repartition("pair", "a", "b").groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))
    frequent = F.when(F.col("n") > min_count, F.struct("pair", "a", "b")).alias("x")
    with Scratch(df.sparkSession, "bigrams") as scratch:
        kept = scratch.write(each.groupBy(frequent).agg(F.max("n").alias("n"), F.count("*").alias("rows")), "counts")
        size = kept.agg(F.sum("rows").alias("size"))
        some = kept.where("x.pair").select("x.a", "x.b", F.col("n").alias("n_ab")).crossJoin(F.broadcast(size))
        words = kept.where("not x.pair")
        first, second = words.select("x.a", F.col("n").alias("n_a")), words.select(F.col("x.a").alias("b"), F.col("n").alias("n_b"))
        score = (F.col("n_ab") - min_count) / F.col("n_a") / F.col("n_b") * F.col("size")
        return scratch.write(some.join(first, "a").join(second, "b").withColumn("score", score).where(F.col("score") > threshold).select("a", "b", "n_ab", "score"), "known", keep=True)


def merge(tokens: Column, starts: Column) -> Column:
    """The tokens with those at the (ascending, not overlapping, from 0) ``starts`` joined to their successors by ``_``.

    The pieces between the merges are copied whole, so the work is linear in the text.
    """
    count, n = F.size(starts), F.size(tokens)

    def piece(j: Column) -> Column:
        begin = F.when(j == 0, F.lit(0)).otherwise(F.get(starts, j - 1) + 2)
        end = F.when(j < count, F.get(starts, j)).otherwise(n)
        joined = F.when(j < count, F.array(F.concat_ws("_", F.get(tokens, end), F.get(tokens, end + 1)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.slice(tokens, begin + 1, end - begin), joined)

    return F.flatten(F.transform(F.sequence(F.lit(0), count), piece))


def starts(tokens_col: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of a shard with ``_starts``: where the known pairs ``a, b`` begin that are merged."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["_shard"])
        lists = rows.column(tokens_col).combine_chunks()
        lens = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(lens) - lens
        doc = np.repeat(np.arange(len(lens)), lens)
        hit = np.zeros(0, np.int64)
        if known.num_rows and len(words):
            a, b = (pc.fill_null(pc.index_in(known.column(c).combine_chunks(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
            pairs = np.unique((a * len(words) + b)[(a >= 0) & (b >= 0)])
            near = (at[:-1] >= 0) & (at[1:] >= 0) & (doc[:-1] == doc[1:])
            hit = np.flatnonzero(near & np.isin(at[:-1] * len(words) + at[1:], pairs))
        new = np.diff(hit, prepend=-2) != 1
        place = np.arange(len(hit))
        hit = hit[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
        ends = np.r_[0, np.cumsum(np.bincount(doc[hit], minlength=len(lens)))]
        found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((hit - first[doc[hit]]).astype(np.int32)))
        return rows.append_column("_starts", found)

    return run


def apply(df: DataFrame, bigrams: DataFrame, id_col: str = "eid", tokens_col: str = "tokens", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``df`` with known bigrams merged greedily from left to right, without overlaps: ``a b`` becomes ``a_b``.

    Rows are dealt into bounded shards, whole, so those that repeat an id keep their own tokens.  A shard draws the bigrams of
    which it holds both words by joins: a bigram travels once a shard, and pairs of neighbours do not travel at all.  In a
    run of known pairs that follow each other, the greedy merge takes every other one from the first on.
    """
    size = df.agg(F.sum(F.size(tokens_col)).alias("n")).first().n or 0
    shards = max(1, -(-size // shard_tokens), min(df.sparkSession.sparkContext.defaultParallelism, size // 20_000))
    rows = df.withColumn("_shard", F.pmod(F.xxhash64(id_col, tokens_col), F.lit(shards)).cast("int"))
    words = rows.select("_shard", F.explode(F.array_distinct(tokens_col)).alias("w")).distinct()
    known = bigrams.select("a", "b").distinct()
    drawn = known.join(words.withColumnRenamed("w", "a"), "a").join(words.withColumnRenamed("w", "b"), ["_shard", "b"]).select(F.col("_shard").alias("_of"), "a", "b")
    found = rows.groupBy("_shard").cogroup(drawn.groupBy("_of")).applyInArrow(starts(tokens_col), StructType([*df.schema.fields, StructField("_starts", ArrayType(IntegerType()))]))
    return found.withColumn(tokens_col, F.when(F.size("_starts") > 0, merge(F.col(tokens_col), F.col("_starts"))).otherwise(F.col(tokens_col))).select(*df.columns)
