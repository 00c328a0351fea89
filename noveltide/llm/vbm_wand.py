"""Ranked lexical search with variable-sized block maxima.

An index is a table of shards that are written once and searched by any number of items:

1. Tasks cut their documents into shards of about ``SHARD_WORDS`` words.  A shard has a posting list per term: document
   numbers and impacts.  A term's weight does not depend on the document, so an impact is a whole number of the index
   and a score the sum of weight times impact.
2. Dynamic programming cuts each list into blocks such that the sum over the blocks of (postings x largest impact) plus a
   fixed cost per block is least; that is the least error of the block bounds for so many blocks.  Long lists are cut every ``SEGMENT``
   postings first; all lists of a shard are worked off together, a place at a time.
3. A search takes the blocks of an item's terms in a shard.  The best postings of one list give a first threshold.
   Lists whose largest scores together fall short of it lead to no document that counts (they hold no pivot); the documents of the other
   lists are candidates, where the blocks over them can reach the threshold: between two neighbouring block ends no
   bound changes, so such stretches are found all at once.  Candidates are scored from the highest bound on, in batches,
   while the bound reaches the ``k``-th best score.  Blocks without candidates are never read.  Nothing is missed,
   ties included.
4. The best ``k`` of each shard are ranked together.

Scores: see ``weight`` and ``impacts``; all but the logarithm is whole-number arithmetic.

Defined results: null texts have no terms and are no documents for the statistics; rows that repeat an id are documents
of their own; documents without an id are ranked last among equals; items without terms that some document holds have no
result; items that repeat an id with another text are items of their own, exact repetitions are one; empty tables give no
rows.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.llm.common import cut, small_batches
from noveltide.llm.shingles import PIECE, mix, powers, text_blocks

#: Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A shard ends after so many words or documents (a longer document is a shard of its own).
SHARD_WORDS, SHARD_DOCS = 2_000_000, 100_000
#: Postings between two fixed cuts, the longest block, and what a block costs in units of impact.
SEGMENT, LONGEST, BLOCK_COST = 256, 64, 1_000_000
#: Rows (term of an item) that are searched for in one pass over the index.
PASS_TERMS = 200_000
GAP = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])

INDEX = "shard string, term long, docs array<int>, impacts array<int>, ends array<int>, ids array<long>"


def weight(n: Column, df: Column) -> Column:
    """Of a term that ``df`` of ``n`` documents hold."""
    return F.floor(1000 * F.log((2 * n + 2) / (2 * df + 1))).cast("long")


def impacts(tf: np.ndarray, n: np.ndarray, own: np.ndarray, docs: int, words: int) -> np.ndarray:
    """``tf`` occurrences in documents ``own`` of ``n`` words each; longer documents than the mean count less."""
    length = np.array([25 + 75 * int(x) * docs // words for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * length[own])


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each term of one piece of text; A-Z are lower-cased."""
    a = np.frombuffer(data.lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, GAP[a], True].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(1 << max(12, int(len(a)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)]
    return starts, mix((total[ends] - total[starts]) * down[starts])


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every term, in order."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if len(data) == 1 and len(data[0]) > PIECE:
        out, at, whole = [], 0, data[0]
        while at < len(whole):
            end = min(len(whole), at + PIECE)
            while end < len(whole) and not GAP[whole[end]]:
                end += 1
            out.append(_hashes(whole[at:end])[1])
            at = end
        return np.zeros(sum(map(len, out)), np.int64), np.concatenate(out).view(np.int64)
    starts, h = _hashes(b"\n".join(data))
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    return np.searchsorted(np.cumsum(sizes), starts, side="right"), h.view(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of each, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def block_ends(values: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST, longest: int = LONGEST, segment: int = SEGMENT) -> np.ndarray:
    """For each value of the lists (``sizes`` values each, one after the other) whether a block ends with it.

    ``least[i]`` is the least sum of (values x largest value + cost) over blocks of a list's first ``i`` values; it is
    ``least[i - b]`` plus a last block of ``b`` values for the best ``b``.  Lists are taken longest first, so those that
    have an ``i``-th value are the first ones.
    """
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // segment)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(first, parts) + number * segment
    lengths = np.minimum(segment, np.repeat(sizes, parts) - number * segment)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    top = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(top + 1), side="right")  # lists of at least so many values
    column = [values[starts[: active[i + 1]] + i] for i in range(top)]
    least, choice = [np.zeros(len(lengths), np.int64)], [np.zeros(0, np.int8)]
    for i in range(1, top + 1):
        k = active[i]
        largest, best, pick = column[i - 1][:k].copy(), None, None
        for b in range(1, min(i, longest) + 1):
            if b > 1:
                np.maximum(largest, column[i - b][:k], out=largest)
            total = least[i - b][:k] + b * largest
            if best is None:
                best, pick = total, np.ones(k, np.int8)
            else:
                better = total < best
                best[better], pick[better] = total[better], b
        least.append(best + cost)
        choice.append(pick)
    out = np.zeros(len(values), bool)
    at, alive = lengths.copy(), np.arange(len(lengths))
    while len(alive):
        out[starts[alive] + at[alive] - 1] = True
        for i in np.unique(at[alive]):
            here = alive[at[alive] == i]
            at[here] -= choice[i][here]
        alive = alive[at[alive] > 0]
    return out


def _lists(parts: np.ndarray, sizes: np.ndarray, kind=pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(parts, kind))


def shard_rows(name: str, ids: pa.Array, own: np.ndarray, h: np.ndarray, docs: int, words: int) -> pa.RecordBatch:
    """The rows of one shard: a list per term, and one row (of no term) with the documents' ids."""
    n = np.bincount(own, minlength=len(ids))
    order = np.argsort(h, kind="stable")  # documents stay in order
    h, own = h[order], own[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.r_[at, len(h)])
    h, own = h[at], own[at]
    value = impacts(tf, n, own, docs, words)
    term = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[term, len(h)])
    ends = np.flatnonzero(block_ends(value, sizes))
    of = np.searchsorted(term, ends, side="right") - 1
    per = np.bincount(of, minlength=len(term))
    k = len(term)
    none = pa.nulls(k, pa.list_(pa.int64()))
    columns = [pa.array([name] * (k + 1), pa.string()), pa.array(np.r_[h[term], 0], mask=np.r_[np.zeros(k, bool), True])]
    empty = pa.nulls(1, pa.list_(pa.int32()))
    columns += [pa.concat_arrays([_lists(x, s), empty]) for x, s in ((own, sizes), (value, sizes), (ends - term[of] + 1, per))]
    columns.append(pa.concat_arrays([none, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]))
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


@dataclass
class Index:
    """``table`` (see INDEX), the number of documents with terms, and of all their terms."""

    table: DataFrame
    docs: int
    words: int


def sizes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Number of texts with terms, and of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = words = 0
        for batch in batches:
            for _, texts in text_blocks(batch, 0, 1_000_000):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                gap = GAP[np.frombuffer(b"\n".join(data), np.uint8)]
                starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]]) if len(gap) else np.zeros(0, np.int64)
                own = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
                docs, words = docs + len(np.unique(own)), words + len(starts)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], names=["docs", "words"])

    each = small_batches(df).select(df[text_col].cast("string").alias("_text")).mapInArrow(run, "docs long, words long")
    row = each.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    return row.docs, row.words


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> Index:
    docs, words = sizes(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, total, made = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            sizes = np.cumsum([0, *[len(i) for i, _, _ in held]])
            own = np.concatenate([o + s for (_, o, _), s in zip(held, sizes, strict=False)])
            return shard_rows(f"{TaskContext.get().partitionId()}-{made}", pa.concat_arrays([i for i, _, _ in held]), own, np.concatenate([h for _, _, h in held]), docs, words)

        for batch in batches:
            for part, texts in text_blocks(batch, 1, 1_000_000):
                own, h = terms_of(texts)
                held.append((part.column(0).cast(pa.int64()), own, h))
                count, total = count + len(texts), total + len(h)
                if total >= shard_words or count >= SHARD_DOCS:
                    yield flush()
                    held, count, total, made = [], 0, 0, made + 1
        if total:
            yield flush()

    table = small_batches(df).select(df[id_col].cast("long").alias("_id"), df[text_col].cast("string").alias("_text")).mapInArrow(run, INDEX)
    return Index(cut(table, "index"), docs, words)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``q, item, term, n``: the terms of each item with their number; ``q`` tells items apart by id and text."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, 2, 1_000_000):
                own, h = terms_of(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(h)], names=["q", "item", "term"])

    rows = items.select(F.xxhash64(items[id_col].cast("string"), items[text_col]).alias("q"), items[id_col].alias("item"), items[text_col].cast("string").alias("text")).dropDuplicates(["q"])
    return rows.mapInArrow(run, f"q long, item {kind}, term long").groupBy("q", "item", "term").agg(F.count("*").alias("n"))


class Shard:
    """The wanted lists of a shard, with their blocks."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        term = table.column("term").combine_chunks()
        has = np.asarray(term.is_valid())
        self.ids = [x for x in table.column("ids").to_pylist() if x is not None][0]
        lists = table.filter(pa.array(has))
        flat = {c: lists.column(c).combine_chunks() for c in ("docs", "impacts", "ends")}
        self.docs, self.impacts = (flat[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("docs", "impacts"))
        sizes, per = (np.asarray(flat[c].value_lengths().to_numpy(zero_copy_only=False), np.int64) for c in ("docs", "ends"))
        start = np.cumsum(sizes) - sizes
        self.block_end = flat["ends"].flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(start, per)
        self.block_start = np.r_[0, self.block_end[:-1]] if len(self.block_end) else self.block_end
        self.top = np.maximum.reduceat(self.impacts, self.block_start) if len(self.block_start) else self.impacts
        self.first, self.last = self.docs[self.block_start], self.docs[self.block_end - 1] + 1
        terms = np.asarray(lists.column("term").to_numpy(), np.int64)
        self.order = np.argsort(terms)
        self.terms = terms[self.order]
        self.list_first, self.list_blocks = np.cumsum(per) - per, per
        self.read = 0  # postings that searches have read

    def gains(self, blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and score of every posting of the blocks."""
        sizes = self.block_end[blocks] - self.block_start[blocks]
        post = spread(self.block_start[blocks], sizes)
        self.read += len(post)
        return self.docs[post], np.repeat(weights, sizes) * self.impacts[post]

    def scores(self, docs: np.ndarray, blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the blocks add to each of the (ascending) documents; only blocks that reach over one are read."""
        some = np.searchsorted(docs, self.last[blocks]) > np.searchsorted(docs, self.first[blocks])
        found, gain = self.gains(blocks[some], weights[some])
        at = np.searchsorted(docs, found)
        at[at == len(docs)] = 0
        same = docs[at] == found
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, at[same], gain[same])
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """``(score, document)`` of the best ``k`` documents with a score above 0."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        found = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        if not found.any():
            return []
        rows = self.order[at[found]]
        of = np.repeat(np.arange(len(rows)), self.list_blocks[rows])
        block = spread(self.list_first[rows], self.list_blocks[rows])
        w = weights[found][of]
        bound = w * self.top[block]
        most = np.maximum.reduceat(bound, np.flatnonzero(np.r_[True, of[1:] != of[:-1]]))
        # A first threshold: the best postings of the list that can add most.
        own = of == np.argmax(most)
        docs, gain = self.gains(block[own], w[own])
        seed = np.sort(docs[np.argsort(-gain, kind="stable")[:k]])
        top = sorted(zip(self.scores(seed, block, w).tolist(), seed.tolist(), strict=True), key=self.rank)
        least = max(1, top[-1][0]) if len(top) == k else 1
        # Lists that together fall short of the threshold lead to no document: the others do.
        order = np.argsort(most)
        leads = np.zeros(len(most), bool)
        leads[order[np.cumsum(most[order]) >= least]] = True
        lead = leads[of]
        # Between two neighbouring block ends the bounds stay as they are.
        edges, place = np.unique(np.r_[self.first[block], self.last[block]], return_inverse=True)
        begin, end = place[: len(block)], place[len(block) :]

        def upper(some: np.ndarray) -> np.ndarray:
            change = np.zeros(len(edges), np.int64)
            np.add.at(change, begin[some], bound[some])
            np.subtract.at(change, end[some], bound[some])
            return np.cumsum(change)

        live = upper(np.ones(len(block), bool)) >= least
        before = np.r_[0, np.cumsum(live)]
        touched = lead & (before[end] > before[begin])
        docs, gain = self.gains(block[touched], w[touched])
        stretch = np.searchsorted(edges, docs, side="right") - 1
        keep = live[stretch]
        docs, own = np.unique(docs[keep], return_inverse=True)
        part = np.zeros(len(docs), np.int64)
        np.add.at(part, own, gain[keep])
        reach = part + upper(~lead)[np.searchsorted(edges, docs, side="right") - 1]
        reach[np.isin(docs, seed)] = 0
        turn = np.argsort(-reach, kind="stable")
        done, size = 0, 64
        while done < len(turn) and reach[turn[done]] >= least:
            chosen = np.sort(turn[done : done + size])
            done, size = done + len(chosen), size * 4
            chosen = chosen[reach[chosen] >= least]
            score = part[chosen] + self.scores(docs[chosen], block[~lead], w[~lead])
            good = score >= least
            top = sorted([*top, *zip(score[good].tolist(), docs[chosen[good]].tolist(), strict=True)], key=self.rank)[:k]
            least = max(1, top[-1][0]) if len(top) == k else 1
        return [t for t in top if t[0] > 0]

    def rank(self, found: tuple[int, int]) -> tuple:
        i = self.ids[found[1]]
        return -found[0], i is None, i or 0


def searcher(q: np.ndarray, term: np.ndarray, w: np.ndarray, k: int) -> Callable[[pa.Table], pa.Table]:
    """Of a shard's wanted lists, ``q, id, score`` of the best documents of all items (rows ``q, term, w``, by ``q``)."""
    ends = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]

    def run(shard: pa.Table) -> pa.Table:
        own, out = Shard(shard), []
        for a, b in zip(starts, ends, strict=True):
            out += [(int(q[a]), own.ids[d], s) for s, d in own.best(term[a:b], w[a:b], k)]
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["q", "id", "score"])

    return run


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item, rank, id, score``: the ``k`` best documents of each item, equal scores by id."""
    spark = items.sparkSession
    asked = item_terms(items, id_col, text_col)
    df = index.table.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    n = F.lit(index.docs)
    rows = asked.join(df, "term").withColumn("w", weight(n, F.col("df")) * F.col("n")).where("w > 0").select("q", "item", "term", "w")
    rows = cut(rows, "asked")
    kind = rows.schema["item"].dataType.simpleString()
    passes = max(1, -(-rows.count() // pass_terms))
    found = []
    for p in range(passes):
        # A pass is a bounded number of rows (but for one item of very many terms): they travel with the code.
        mine = rows.where(F.pmod("q", F.lit(passes)) == p)
        table = mine.select("q", "term", "w").orderBy("q").toArrow()
        if not table.num_rows:
            continue
        q, term, w = (table.column(c).to_numpy() for c in ("q", "term", "w"))
        wanted = F.broadcast(spark.createDataFrame(pa.table([pa.array(np.unique(term))], names=["wanted"])))
        lists = index.table.join(wanted, F.col("term") == F.col("wanted"), "left").where("term is null or wanted is not null").drop("wanted")
        best = lists.groupBy("shard").applyInArrow(searcher(q, term, w, k), "q long, id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found.append(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    if not found:
        return spark.createDataFrame([], f"item {kind}, rank int, id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.join(rows.select("q", "item").distinct(), "q").select("item", "rank", "id", "score")
