"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids (k-means on a bounded sample) deal all vectors into lists; what is left of a vector beside its
centroid is product-quantised.  A query probes the lists whose centroids have the largest inner products with it, scores
their codes by asymmetric distance tables, and its best codes are reranked by the exact inner product of the original
vectors.  A residual is quantised by its direction, and its length is kept, so lists of any width are told apart.

A few of the queries are searched by brute force among all vectors, and every code is scored for them.  So the probes, the
codes that a query takes from a group, and those that are reranked are as many as these queries need for the target
recall; where that is too many, finer codes are made.  The finished search is held against them as well.  A query that
finds fewer than ``k`` candidates probes all lists.  Copies of a vector are indexed and searched once, and of their ids the
``k + 1`` smallest are looked up afterwards: no query can return another.

Every vector is indexed; only the training sample is bounded: ``per_list`` vectors a list, and ``sample_mb``.  Lists are
dealt into groups of a bounded number of rows (large lists into shards first), and the queries that probe a group into
blocks.  Codes travel to the queries; of the vectors, those of survivors alone.

Defined results: rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite components take
no part; vectors are compared with those of their own length; rows that repeat id and vector count once, and rows that
share an id but not the vector are rows of their own; ties in the inner product go to the smaller id; a query with fewer
candidates than ``k`` gets them all; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.llm.common import cut, discard


@dataclass
class IvfParams:
    """``lists``: in square roots of the number of vectors.  ``rerank``: so many codes of a query are reranked at least."""

    lists: float = 4.0
    max_lists: int = 4096
    per_list: int = 32
    sample_mb: int = 64
    subspaces: int = 16
    target_recall: float = 0.98
    rerank: int = 256
    trial_queries: int = 128
    least_recall: float = 0.95
    rounds: int = 8
    group_rows: int = 65_536
    block_queries: int = 16_384
    seed: int = 5


@dataclass
class IvfIndex:
    params: IvfParams
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x 256 x width
    probes: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Rows of bytes: a code per subspace, and the length of the residual in four."""
        far, length = directions(x - self.centroids[lists])
        codes = np.stack([nearest(p, b) for p, b in zip(split(far, len(self.books)), self.books, strict=True)], axis=1).astype(np.uint8)
        return np.concatenate([codes, length.astype("<f4")[:, None].view(np.uint8)], axis=1)

    def rough(self, tables: np.ndarray, coarse: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Estimated inner products, queries x rows; ``coarse`` are those with the rows' centroids."""
        m = len(self.books)
        places = (rows[:, :m].astype(np.int32) + 256 * np.arange(m, dtype=np.int32)).ravel()
        length = np.ascontiguousarray(rows[:, m:]).view("<f4")[:, 0]
        return np.take(tables, places, axis=1).reshape(len(tables), len(rows), m).sum(axis=2) * length + coarse

    def probe(self, q: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query the inner products with all codes: queries x (subspaces * 256)."""
        return np.concatenate([p @ b.T for p, b in zip(split(q, len(self.books)), self.books, strict=True)], axis=1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (zeros stay), and their lengths."""
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    return x / np.where(length > 0, length, 1)[:, None], length


def split(x: np.ndarray, m: int) -> list[np.ndarray]:
    width = -(-x.shape[1] // m)
    x = np.pad(x, ((0, 0), (0, width * m - x.shape[1])))
    return [x[:, k * width : (k + 1) * width] for k in range(m)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, out = (centres**2).sum(axis=1) / 2, np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (x[lo : lo + 4096] @ centres.T - half).argmax(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = count > 0
        total = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0)
        centres[full] = total / count[full, None]
        if (~full).any():  # an empty cell starts anew at a point
            centres[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centres


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vh, d, vec``: the vectors that take part, once each, with a hash and their length."""
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("vec"))
    rows = rows.where("id is not null and vec is not null").where(F.size(v) > 0).where(fine)
    return rows.select("id", F.xxhash64(v).alias("vh"), F.size(v).alias("d"), "vec").dropDuplicates(["id", "vh"])


def matrix(column: pa.Array | pa.ChunkedArray, scale: float = 1.0) -> np.ndarray:
    """Rows of vectors, divided by ``scale``, as 32-bit floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = (column.flatten().to_numpy(zero_copy_only=False) / scale).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def fit(vectors: DataFrame, n: int, dim: int, params: IvfParams | None = None, k: int = 20, scale: float = 1.0) -> IvfIndex:
    """The index of ``n`` usable vectors of one length."""
    p = params or IvfParams()
    lists = max(1, min(p.max_lists, round(p.lists * math.sqrt(n)), n // 4 or 1))
    sample = max(256, min(p.per_list * lists, (p.sample_mb << 20) // (4 * dim)))
    share = min(1.0, 1.2 * sample / n)
    drawn = vectors.where(F.pmod(F.xxhash64("id", "vh"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).select("id", "vh", "vec").toArrow()
    drawn = drawn.take(pa.array(np.lexsort((drawn["vh"].to_numpy(), drawn["id"].to_numpy()))))  # the same whatever the partitions
    x, rng = matrix(drawn["vec"], scale), np.random.default_rng(p.seed)
    if not len(x):  # a sample of a few vectors can be empty
        x = matrix(vectors.orderBy("id", "vh").limit(sample).select("vec").toArrow()["vec"], scale)
    x = x[rng.permutation(len(x))[:sample]]
    lists = max(1, min(lists, len(x) // 4 or 1))
    index = IvfIndex(p, kmeans(x, lists, p.rounds, rng), np.zeros((0,)), lists)
    own = index.assign(x)
    index.books = np.stack([kmeans(r, 256, p.rounds, rng) for r in split(directions((x - index.centroids[own])[:20_000])[0], min(p.subspaces, dim))])
    tries = x[:400]
    best = np.argsort(-(tries @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(tries @ index.centroids.T), axis=1), axis=1)
    need = place[np.arange(len(tries))[:, None], own[best]].ravel()
    if len(need):
        index.probes = int(min(lists, np.quantile(need, p.target_recall, method="higher") + 1))
    return index


def survivors(ix: IvfIndex, left: pa.Table, right: pa.Table, depth: int) -> pa.Table:
    """``query_id, query_vh, id, vh, rough``: of each query the best codes of a group, among the lists that it probes."""
    names = ["query_id", "query_vh", "id", "vh", "rough"]
    none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float32())], names=names)
    if not left.num_rows or not right.num_rows:
        return none
    unit = left["unit"].to_numpy()
    order = np.lexsort((left["vh"].to_numpy(), left["id"].to_numpy(), unit))
    unit, ids, vhs, lists = unit[order], left["id"].to_numpy()[order], left["vh"].to_numpy()[order], left["list"].to_numpy()[order]
    codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
    units, begin = np.unique(unit, return_index=True)
    end = np.r_[begin[1:], len(unit)]
    qs, qid, qvh, probed = right["q"].combine_chunks(), right["query_id"].to_numpy(), right["query_vh"].to_numpy(), right["units"].combine_chunks()
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, min(256, (1 << 24) // len(ids)))  # queries in work at once
    for lo in range(0, len(qid), step):
        q = matrix(qs[lo : lo + step])
        mine = probed[lo : lo + step]
        owner = np.repeat(np.arange(len(q)), mine.value_lengths().to_numpy())
        wanted = np.searchsorted(units, mine.flatten().to_numpy())
        by = np.argsort(wanted, kind="stable")
        owner, wanted = owner[by], wanted[by]
        tables, coarse = ix.tables(q), q @ ix.centroids.T
        rough = np.full((len(q), len(ids)), -np.inf, np.float32)
        edges = np.searchsorted(wanted, np.arange(len(units) + 1))
        for u in range(len(units)):
            who = owner[edges[u] : edges[u + 1]]
            for a in range(begin[u], end[u], 4096) if len(who) else ():
                z = min(end[u], a + 4096)
                for w in range(0, len(who), 64):
                    some = who[w : w + 64]
                    rough[some, a:z] = ix.rough(tables[some], coarse[some, lists[a]][:, None], codes[a:z])
        rough[(ids[None, :] == qid[lo : lo + step, None]) & (vhs[None, :] == qvh[lo : lo + step, None])] = -np.inf
        top = np.argpartition(-rough, depth, axis=1)[:, :depth] if rough.shape[1] > depth else np.broadcast_to(np.arange(rough.shape[1]), rough.shape)
        row = np.repeat(np.arange(len(q)), top.shape[1])
        col = top.ravel()
        some = np.isfinite(rough[row, col])
        row, col = row[some], col[some]
        out.append((qid[lo + row], qvh[lo + row], ids[col], vhs[col], rough[row, col]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


@dataclass
class Trial:
    """Some queries, and of each (row ``owner`` of ``q``) the true neighbours among all vectors."""

    q: np.ndarray
    ids: list[tuple[int, int]]
    owner: np.ndarray
    found: list[tuple[int, int]]
    vecs: np.ndarray


def trial(vectors: DataFrame, asked: DataFrame, k: int, p: IvfParams, scale: float) -> Trial:
    """``trial_queries`` of the queries by a hash, with their ``k`` nearest by brute force in every partition."""
    some = asked.orderBy(F.xxhash64("vh", "id"), "id").limit(p.trial_queries).select("id", "vh", "vec").collect()
    spark, q64 = vectors.sparkSession, np.array([r.vec for r in some], float) / scale
    own = np.array([(r.id, r.vh) for r in some], np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vhs, top = (np.zeros((len(q64), 0), t) for t in (np.int64, np.int64, float))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) / scale
                i, h = part.column(0).to_numpy(), part.column(1).to_numpy()
                score = q64 @ x.T
                score[(i[None, :] == own[:, :1]) & (h[None, :] == own[:, 1:])] = -np.inf
                ids, vhs, top = np.c_[ids, np.tile(i, (len(q64), 1))], np.c_[vhs, np.tile(h, (len(q64), 1))], np.c_[top, score]
                if top.shape[1] > k:
                    keep = np.argpartition(-top, k - 1, axis=1)[:, :k]
                    ids, vhs, top = (np.take_along_axis(a, keep, axis=1) for a in (ids, vhs, top))
        row = np.repeat(np.arange(len(q64)), top.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (row, ids.ravel(), vhs.ravel(), top.ravel())], names=["row", "id", "vh", "score"])

    near = vectors.select("id", "vh", "vec").mapInArrow(best, "row long, id long, vh long, score double").where(F.col("score") > float("-inf"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id", "vh"))
    pairs = cut(near.withColumn("place", place).where(F.col("place") <= k).select("row", "id", "vh"), "truth")  # at most k rows a trial query
    rows = vectors.join(F.broadcast(pairs), ["id", "vh"]).select("row", "id", "vh", "vec").orderBy("row", "id", "vh").collect()
    discard(pairs)
    vecs = (np.array([r.vec for r in rows], float) / scale).astype(np.float32)
    return Trial(q64.astype(np.float32), [(r.id, r.vh) for r in some], np.array([r.row for r in rows], np.int64), [(r.id, r.vh) for r in rows], vecs)


def code_ranks(codes: DataFrame, ix: IvfIndex, t: Trial, group_of_list: list[set[int]], probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each true neighbour of the trial: how many codes of the probed lists score at least as high, in all and among the lists of its groups."""
    own = ix.assign(t.vecs)
    tables, coarse = ix.tables(t.q), t.q @ ix.centroids.T
    coded, at = ix.encode(t.vecs, own), t.owner
    least = np.array([ix.rough(tables[[o]], coarse[[o], own[k]][:, None], coded[k : k + 1])[0, 0] for k, o in enumerate(at)])
    least -= 1e-5 * np.abs(least)
    probed = np.zeros((len(t.q), len(ix.centroids)), bool)
    np.put_along_axis(probed, ix.probe(t.q, probes), True, axis=1)
    beside = np.array([[not group_of_list[a].isdisjoint(group_of_list[b]) for b in range(len(group_of_list))] for a in np.unique(own)], bool)
    beside = beside[np.searchsorted(np.unique(own), own)]
    edges = np.searchsorted(at, np.arange(len(t.q) + 1))
    shared = codes.sparkSession.sparkContext.broadcast((ix, tables, coarse, least, probed, beside, edges))  # bounded by trial_queries and max_lists

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, tables, coarse, least, probed, beside, edges = shared.value
        total = np.zeros((2, len(least)), np.int64)
        for b in batches:
            lists = b.column(0).to_numpy()
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(lists), -1)
            for lo in range(0, len(lists), 2048):
                mine = lists[lo : lo + 2048]
                score = np.where(probed[:, mine], ix.rough(tables, coarse[:, mine], rows[lo : lo + 2048]), -np.inf)
                for i in range(len(edges) - 1):
                    a, z = edges[i], edges[i + 1]
                    above = score[i][None, :] >= least[a:z, None]
                    total[0, a:z] += above.sum(axis=1)
                    total[1, a:z] += (above & beside[a:z][:, mine]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least))), pa.array(total[0]), pa.array(total[1])], names=["k", "n", "m"])

    rows = codes.select("list", "code").mapInArrow(count, "k long, n long, m long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).orderBy("k").collect()
    inside = probed[at, own]
    n, m = np.array([r.n for r in rows])[inside], np.array([r.m for r in rows])[inside]
    return n, m


def _search(vectors: DataFrame, n: int, dim: int, asked: DataFrame, k: int, p: IvfParams, scale: float) -> DataFrame:
    """The ``k`` nearest of each query among ``n`` distinct vectors of one length: ``query_vh, vh, score``."""
    spark = vectors.sparkSession
    total = asked.count()
    known = trial(vectors, asked, k, p, scale)
    while True:
        index = fit(vectors, n, dim, p, k, scale)
        if len(known.found):
            order = np.argsort(np.argsort(-(known.q @ index.centroids.T), axis=1, kind="stable"), axis=1)
            need = order[known.owner, index.assign(known.vecs)]
            index.probes = int(min(len(index.centroids), np.quantile(need, p.target_recall, method="higher") + 1))
        found, fine = _searched(vectors, n, dim, asked, total, k, p, scale, index, known)
        if fine or p.subspaces >= dim:
            return found
        p = replace(p, subspaces=2 * p.subspaces)


def _searched(vectors: DataFrame, n: int, dim: int, asked: DataFrame, total: int, k: int, p: IvfParams, scale: float, index: IvfIndex, known: Trial) -> tuple[DataFrame | None, bool]:
    """The result, or false if the codes are too coarse and can be finer."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(index)  # bounded by max_lists and 256 codes per subspace

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            x = matrix(b.column(2), scale)
            if len(x):
                own = ix.assign(x)
                codes = [c.tobytes() for c in ix.encode(x, own)]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), b.column(1), pa.array(codes, pa.binary())], names=["list", "id", "vh", "code"])

    codes = cut(vectors.select("id", "vh", "vec").mapInArrow(deal, "list int, id long, vh long, code binary"), "codes")
    sizes = {r.list: r.n for r in codes.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most max_lists rows
    # A unit is a list, or a shard of a large one; units are dealt into groups of about so many rows.
    first, group, filled, units = [], 0, 0, 0
    groups: list[int] = []
    target = min(p.group_rows, max(2048, -(-n // spark.sparkContext.defaultParallelism)))
    for i in range(len(index.centroids)):
        shards = max(1, -(-sizes.get(i, 0) // p.group_rows))
        first.append((i, units, shards))
        for _ in range(shards):
            if filled >= target:
                group, filled = group + 1, 0
            groups.append(group)
            filled += -(-sizes.get(i, 0) // shards)
        units += shards
    starts, many = np.array([u for _, u, _ in first]), np.array([s for _, _, s in first])
    group_of = np.array(groups)
    depth = each = min(n, max(p.rerank, 2 * k))
    if len(known.found):
        ranks, beside = code_ranks(codes, index, known, [set(group_of[u : u + c].tolist()) for _, u, c in first], index.probes)
        share = (1 + p.target_recall) / 2
        depth = int(min(n, max(depth, 1.25 * np.quantile(ranks, share, method="higher") + k))) if len(ranks) else depth
        if depth > 4 * p.rerank and p.subspaces < dim:
            discard(codes)
            return None, False
        each = int(min(depth, max(2 * k, 1.5 * np.quantile(beside, share, method="higher") + k))) if len(ranks) else depth

    def probe_all(probes: int):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    q = matrix(part.column(2), scale)
                    lists = ix.probe(q, probes)
                    count = many[lists]
                    owner = np.repeat(np.arange(len(q)), count.sum(axis=1))
                    flat = count.ravel()
                    unit = np.repeat(starts[lists].ravel() - (np.cumsum(flat) - flat), flat) + np.arange(int(flat.sum()))
                    order = np.lexsort((unit, group_of[unit], owner))
                    owner, unit = owner[order], unit[order]
                    key = owner * (len(group_of) + 1) + group_of[unit]
                    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                    lists_of = pa.ListArray.from_arrays(pa.array(np.r_[edge, len(unit)].astype(np.int32)), pa.array(unit.astype(np.int32)))
                    take = pa.array(owner[edge])
                    short = pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), q.shape[1]).cast(pa.list_(pa.float32()))
                    cols = [pa.array(group_of[unit[edge]].astype(np.int32)), part.column(0).take(take), part.column(1).take(take), short.take(take), lists_of]
                    yield pa.RecordBatch.from_arrays(cols, names=["grp", "query_id", "query_vh", "q", "units"])

        return probe

    def run(some: DataFrame, probes: int, count: int, depth: int, each: int) -> DataFrame:
        """Exactly reranked survivors of these queries."""
        blocks = max(1, -(-count // p.block_queries))
        by_list = spark.createDataFrame([(i, u, s, [int(g) for g in group_of[u : u + s]]) for i, u, s in first], "list int, start int, shards int, groups array<int>")
        shard = F.pmod(F.xxhash64("id", "vh"), F.col("shards")).cast("int")
        left = codes.join(F.broadcast(by_list), "list").withColumn("s", shard)  # one row per list
        left = left.select("list", (F.col("start") + F.col("s")).alias("unit"), F.get("groups", "s").alias("grp"), "id", "vh", "code", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = some.select("id", "vh", "vec").mapInArrow(probe_all(probes), "grp int, query_id long, query_vh long, q array<float>, units array<int>")
        right = right.withColumn("block", F.pmod(F.xxhash64("query_id", "query_vh"), F.lit(blocks)).cast("int"))
        rough = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(lambda a, b: survivors(shared.value, a, b, each), "query_id long, query_vh long, id long, vh long, rough float")
        w = Window.partitionBy("query_id", "query_vh").orderBy(F.desc("rough"), "id", "vh")
        best = rough.withColumn("place", F.row_number().over(w)).where(F.col("place") <= depth).drop("place", "rough")
        near = best.join(vectors.select("id", "vh", F.col("vec").alias("x")), ["id", "vh"])
        near = near.join(some.select(F.col("id").alias("query_id"), F.col("vh").alias("query_vh"), F.col("vec").alias("q")), ["query_id", "query_vh"])
        rank = F.row_number().over(Window.partitionBy("query_id", "query_vh").orderBy(F.desc("score"), "id", "vh"))
        return near.select("query_id", "query_vh", "id", "vh", dot("x", "q").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)

    probes, lists = index.probes, len(index.centroids)
    found = cut(run(asked, probes, total, depth, each), "found")
    true = set(zip(known.owner.tolist(), known.found, strict=True))
    trials = spark.createDataFrame([(i, *r) for i, r in enumerate(known.ids)], "row long, query_id long, query_vh long")
    while true and (probes < lists or depth < n):  # what the trial queries find, after all
        mine = found.join(F.broadcast(trials), ["query_id", "query_vh"]).select("row", "id", "vh").collect()
        if len(true & {(r.row, (r.id, r.vh)) for r in mine}) >= p.least_recall * len(true):
            break
        probes, depth = min(lists, 4 * probes), min(n, 4 * depth)
        discard(found)
        found = cut(run(asked, probes, total, depth, depth), "found")
    least = min(k, n - 1)
    full = found.groupBy("query_id", "query_vh").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("query_id").alias("id"), F.col("query_vh").alias("vh"))
    if probes < lists and full.count() < total and least:
        short = cut(asked.join(full, ["id", "vh"], "left_anti").select("id", "vh", "vec"), "short")
        again = cut(run(short, lists, short.count(), depth, depth), "again")
        kept = found.join(short.select(F.col("id").alias("query_id"), F.col("vh").alias("query_vh")), ["query_id", "query_vh"], "left_anti")
        found = kept.select(*again.columns).unionByName(again)
    discard(codes)
    return found.select("query_vh", "vh", "score"), True


def expanded(rows: DataFrame, asked: DataFrame, found: DataFrame, queries: Column, k: int) -> DataFrame:
    """``query_id, query_vh, rank, id, score`` of query rows, from the nearest of each distinct query vector."""
    place = F.row_number().over(Window.partitionBy("vh").orderBy("id"))
    copies = rows.select("id", "vh").withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    same = asked.select(F.col("vh").alias("query_vh"), "vh", dot("vec", "vec").alias("score"))
    each = found.unionByName(same).join(copies, "vh")
    order = F.row_number().over(Window.partitionBy("query_vh").orderBy(F.desc("score"), "id", "vh"))
    lists = each.withColumn("place", order).where(F.col("place") <= k + 1).groupBy("query_vh").agg(F.array_sort(F.collect_list(F.struct("place", "id", "vh", "score"))).alias("near"))
    askers = rows.where(queries).select(F.col("id").alias("query_id"), F.col("vh").alias("query_vh")).join(lists, "query_vh")
    others = F.slice(F.filter("near", lambda x: (x["id"] != F.col("query_id")) | (x["vh"] != F.col("query_vh"))), 1, k)
    out = askers.select("query_id", "query_vh", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", "query_vh", (F.col("at") + 1).cast("int").alias("rank"), "x.id", "x.score")


def search(df: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, params: IvfParams | None = None) -> DataFrame:
    """``query_id, query_vh, rank, id, score``: the ``k`` nearest (largest inner product) to each row that ``queries`` selects.

    ``queries`` is a condition on ``id``.  A query's own row is no candidate.  ``query_vh`` tells query rows of one id apart.
    """
    rows = cut(usable(df, id_col, vec_col), "vectors")
    each = rows.groupBy("d").agg(F.countDistinct("vh").alias("n"), F.count_if(queries).alias("asked"), F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).where("asked > 0").orderBy("d").collect()
    parts = []
    for r in each:
        mine = rows.where(F.col("d") == r.d)
        first = mine.groupBy("vh").agg(F.min("id").alias("id"))
        vectors = cut(mine.join(first, ["vh", "id"]).select("id", "vh", "vec"), "distinct")
        # Written on their own, the queries have a known size: a few are sent to all, many are dealt out.
        asked = cut(vectors.join(mine.where(queries).select("vh").distinct(), "vh", "left_semi").select("id", "vh", "vec"), "asked")
        parts.append(expanded(mine, asked, _search(vectors, r.n, r.d, asked, k, params or IvfParams(), r.most), queries, k))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "query_id long, query_vh long, rank int, id long, score double")
