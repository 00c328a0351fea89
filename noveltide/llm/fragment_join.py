"""N-gram Jaccard join by vertical partitioning, and the classes that its links make.

Texts are sets of word n-grams (64-bit hashes); two link when ``100 * |A n B| >= percent * |A u B|``.  Equal sets are
one node from the start.  The stages, each a shuffle on a key that is counted or combined before it is dealt:

1. Isolated nodes go.  In any global order of the n-grams, two linking sets share some of the first
   ``n - need + l`` n-grams of both; nodes with too few shared n-grams among their first (in hash order) link with none.
2. The n-grams of the rest are counted.  A node whose n-grams that others have fall short of ``need`` goes.
3. The global order is by (count, hash).  Its first n-grams make the postings: nodes that could link share one.
4. The order is cut into fragments; per candidate pair the overlaps are counted in each fragment separately (on the
   nodes' segments) and summed.
5. Not all pairs of a posting are compared.  First, each node is compared with the most typical of its postings' hubs,
   and links are contracted to components; postings whose members are all in one component are done, here and later.
   In small postings, every two members of different components are compared that can reach the overlap.  In large
   ones every member is compared with the hub.  Two members that link with it are in one component; one that is farther
   than twice the limit from it links with none of those (triangle inequality of the Jaccard distance) and goes on to
   other hubs; for the rest, with h the hub, ``|A ^ B| = |A ^ h| + |B ^ h| - 2 |(A ^ h) n (B ^ h)|`` says how many differences
   from the hub two nodes must share if one of them does not link with it.  So their postings are those of these
   differences, rarest first, and the round begins anew, with four times the size as small.  A group of near copies costs
   about a pair per member, and no pair that could join two components is left out.

Defined results: null ids are returned with a null component and link with nothing; null texts and texts without words
have no n-grams and are their own component; rows that repeat an id are documents of their own with one id; a class's
id is the smallest id in it.  Sets and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide.llm.common import cut, discard, small_batches
from noveltide.llm.shingles import sets_of, text_blocks

EDGE = 8  # in stage 1, a node must share an 8th of what it needs at least, among its first n-grams
#: Postings of so many members are compared pair by pair; four times as many in each later round.
FEW = 16
SHARE_BITS = 12


def need(n, percent: int):
    """The overlap that a set of ``n`` must have with any set that it links with (for columns and arrays)."""
    return (n * percent + 99) / 100 if not isinstance(n, np.ndarray) else (n * percent + 99) // 100


def _map(df: DataFrame, id_col: str, text_col: str, run, schema: str) -> DataFrame:
    return small_batches(df).select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text")).mapInArrow(run, schema)


def nodes(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, node`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b, 1, 1_000_000):
                _, _, n, node = sets_of(texts, width)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(node)], names=["id", "n", "node"])

    return _map(df, id_col, text_col, run, "id long, n long, node long")


def first_grams(df: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``g, who``: the first n-grams of each row in hash order (40 bits), and 52 bits of its node with what it must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b, 1, 1_000_000):
                own, h, n, node = sets_of(texts, width)
                least = need(n, percent)
                first = n - least + np.maximum(1, n // EDGE)
                share = np.minimum(np.maximum(1, least // EDGE), (1 << SHARE_BITS) - 1)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                valid = np.asarray(part.column(0).is_valid())
                keep = (place < first[own]) & valid[own]
                who = (node << SHARE_BITS) | share
                # Rows of one set in a block say the same.
                _, once = np.unique(node, return_index=True)
                lone = np.zeros(len(node), bool)
                lone[once] = True
                if not valid.all():
                    lone[:] = True
                keep &= lone[own]
                yield pa.RecordBatch.from_arrays([pa.array((h[keep] >> 24) & ((1 << 40) - 1)), pa.array(who[own[keep]])], names=["g", "who"])

    return _map(df, id_col, text_col, run, "g long, who long")


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """``node, n, grams`` of rows ``_id, _text, node`` whose text has that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b, 1, 1_000_000):
                _, h, n, node = sets_of(texts, width)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h))
                same = pa.array(node == part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int64)), lists], names=["node", "n", "grams"]).filter(same)

    return small_batches(df).select("_id", "_text", "node").mapInArrow(run, "node long, n long, grams array<long>")


def candidates(df: DataFrame, ids: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Stages 1 and 2: ``node, n, shared`` (array of (df, gram), in the global order) of nodes that may link."""
    first = first_grams(df, width, percent, id_col, text_col)
    # Counted keys are written before they are joined: only then can a join deal out a hot key's rows anew.
    common = cut(first.groupBy("g").agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a <> b").select("g"), "common")
    again = first_grams(df, width, percent, id_col, text_col)
    met = again.join(common, "g", "left_semi").groupBy("who").agg(F.count("*").alias("k"))
    mask = F.lit((1 << SHARE_BITS) - 1)
    left = cut(met.where(F.col("k") >= F.col("who").bitwiseAND(mask)).select(F.shiftright("who", SHARE_BITS).alias("low")).distinct(), "left")
    discard(common)
    one = ids.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id")).withColumn("low", F.shiftright(F.shiftleft("node", SHARE_BITS), SHARE_BITS))
    kept = one.join(left, "low", "left_semi").select("id", "node")
    rows = df.select(df[id_col].cast("long").alias("_id"), df[text_col].cast("string").alias("_text"))
    sets = cut(full_sets(rows.join(kept, rows["_id"] == kept["id"]), width).dropDuplicates(["node"]), "sets")
    grams = sets.select("node", "n", F.explode("grams").alias("g"))
    counts = cut(grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    shared = grams.join(counts, "g").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("shared"))
    out = cut(shared.where(F.size("shared") >= F.floor(need(F.col("n"), percent))), "shared")
    return out


def segments(shared: DataFrame, fragments: int) -> DataFrame:
    """``node, fragment, grams``: the global order cut at quantiles into ranges, and each node's part of each."""
    # The place in the order as a number: the count, and the hash as its fraction.
    place = lambda x: x["df"] + (x["g"] / F.lit(2.0**64) + 0.5)
    probs = [k / fragments for k in range(1, fragments)]
    cuts = shared.select(F.explode("shared").alias("x")).agg(F.percentile_approx(place(F.col("x")), probs, 1000).alias("q")).first().q or []
    edges = [None, *sorted(set(cuts)), None]

    def part(k: int):
        lo, hi = edges[k], edges[k + 1]
        inside = lambda x: (F.lit(True) if lo is None else place(x) >= lo) & (F.lit(True) if hi is None else place(x) < hi)
        return F.struct(F.lit(k).alias("fragment"), F.transform(F.filter("shared", inside), lambda x: x["g"]).alias("grams"))

    each = shared.select("node", F.explode(F.array(*[part(k) for k in range(len(edges) - 1)])).alias("s"))
    return each.select("node", "s.fragment", "s.grams").where(F.size("grams") > 0)


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``a, b, na, nb, k`` of pairs ``a, b, na, nb``: partial overlaps per fragment, summed per pair (none if zero)."""
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    each = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("k"))
    return each.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k")).where("k > 0")


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b, na, nb``, each once and with the smaller node first."""
    swap = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"))
    return pairs.select(F.when(F.col("a") < F.col("b"), F.struct("a", "b", "na", "nb")).otherwise(swap).alias("p")).select("p.*").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` (the smallest vertex reachable) of every vertex of the edges ``a, b``."""
    both = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("seen")), "w").groupBy("v").agg(F.min("seen").alias("seen"))
        down = labels.join(near, "v").select("v", F.least("label", "seen").alias("next"), "label")
        jump = down.join(labels.select(F.col("v").alias("next"), F.col("label").alias("far")), "next").select("v", F.least("next", "far").alias("label"), F.col("label").alias("old"))
        jumped = cut(jump, "labels")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("v", "label")
        labels = jumped.select("v", "label")


def first_postings(shared: DataFrame, percent: int) -> DataFrame:
    """``g, node, n, typ, v, rest, must, comp``: the n-grams by which nodes meet, seen as differences from the empty set.

    ``v`` and ``rest`` bound what two nodes share: a pair can link only if ``v + v' <= 2 (100 + percent) min(rest, rest')``,
    where ``rest`` counts the node's n-grams from this one on.  ``typ``: how common the node's n-grams are on the whole.
    """
    s = F.size("shared")
    count = (s - F.floor(need(F.col("n"), percent)) + 1).cast("int")
    typ = F.aggregate("shared", F.lit(0.0), lambda t, x: t + F.log(x["df"].cast("double"))) / F.col("n")
    # Named below the generator: above it, they would be worked out for each n-gram.
    rows = shared.select("node", "n", typ.alias("typ"), s.alias("s"), F.slice("shared", F.lit(1), count).alias("first"))
    rows = rows.select("node", "n", "typ", "s", F.posexplode("first").alias("i", "x"))
    v = (2 * percent * F.col("n")).cast("long")
    return rows.select(F.col("x.g").alias("g"), "node", "n", "typ", v.alias("v"), (F.col("s") - F.col("i")).alias("rest"), F.lit(True).alias("must"), F.col("node").alias("comp"))


def active(posts: DataFrame) -> DataFrame:
    """``g, size, hub`` of the postings whose members are in several components; the hub is the most typical member."""
    hub = F.max(F.struct("typ", "node", "n", "v", "rest", "comp")).alias("hub")
    return posts.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), hub).where("lo <> hi").select("g", "size", "hub")


def merge(label: DataFrame, links: DataFrame, shared: DataFrame) -> DataFrame:
    """The labels after the links are contracted: ``node, comp`` of nodes that have another label than their own."""
    known = shared.select("node").join(label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    ends = links.join(known.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(known.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    new = known.join(merged, known["comp"] == merged["v"], "left").select("node", F.coalesce("label", "comp").alias("comp"))
    return cut(new.where("node <> comp"), "comps")


def relabelled(posts: DataFrame, label: DataFrame) -> DataFrame:
    return posts.drop("comp").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def refined(kinds: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The postings of members near a hub: the n-grams by which they differ from it, rarest of the hub's group first.

    Two nodes of which one does not link with the hub can link only if they share differences from it, at least
    ``(v + v') / (2 (100 + percent))`` of them; so each needs only so many of its differences as postings.
    """
    close = kinds.where("not far")
    bounds = cut(close.groupBy("h").agg(F.min("v").alias("least"), F.min(F.when(~F.col("linked"), F.col("v"))).alias("out")).where("out is not null"), "bounds")
    close = close.join(bounds, "h")
    grams = shared.select(F.col("node").alias("x"), F.transform("shared", lambda s: s["g"]).alias("gs"))
    both = close.join(grams.select(F.col("x").alias("node"), "gs"), "node").join(grams.select(F.col("x").alias("h"), F.col("gs").alias("hs")), "h")
    delta = cut(both.select("h", "node", "linked", F.explode(F.concat(F.array_except("gs", "hs"), F.array_except("hs", "gs"))).alias("d")), "delta")
    # Shared ones, with a node that does not link with the hub.
    counts = cut(delta.groupBy("h", "d").agg(F.count("*").alias("c"), F.min("linked").alias("all")).where("c > 1 and not all").select("h", "d", "c"), "counts")
    listed = delta.join(counts, ["h", "d"]).groupBy("h", "node").agg(F.array_sort(F.collect_list(F.struct("c", "d"))).alias("ds"))
    least = F.ceil((F.col("v") + F.when(F.col("linked"), F.col("out")).otherwise(F.col("least"))) / (2.0 * (100 + percent)))
    rows = listed.join(close, ["h", "node"]).withColumn("s", F.size("ds")).withColumn("need", F.greatest(F.lit(1), least)).where("s >= need")
    rows = rows.select("h", "node", "n", "typ", "v", "s", "linked", F.posexplode(F.slice("ds", F.lit(1), (F.col("s") - F.col("need") + 1).cast("int"))).alias("i", "x"))
    return rows.select(F.xxhash64("h", "x.d").alias("g"), "node", "n", "typ", "v", (F.col("s") - F.col("i")).alias("rest"), (~F.col("linked")).alias("must"))


def link(shared: DataFrame, percent: int, fragments: int, few: int = FEW) -> DataFrame:
    """Stages 3 to 5: ``node, comp`` of the nodes that link with others."""
    scale = 2 * (100 + percent)
    posts = first_postings(shared, percent)
    several = cut(posts.groupBy("g").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("g"), "several")
    posts = cut(posts.join(several, "g", "left_semi"), "posts")
    parts = cut(segments(shared, fragments), "segments")
    discard(several)

    def linked(sums: DataFrame) -> DataFrame:
        return sums.where(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")

    # First, each node is compared with the most typical of its postings' hubs alone.
    live = posts.join(cut(active(posts), "active"), "g").where("node <> hub.node").where(F.col("v") + F.col("hub.v") <= scale * F.least("rest", "hub.rest"))
    best = live.groupBy("node", "n").agg(F.max(F.struct("hub.typ", "hub.node", "hub.n")).alias("h"))
    pairs = cut(ordered(best.select(F.col("node").alias("a"), F.col("h.node").alias("b"), F.col("n").alias("na"), F.col("h.n").alias("nb"))), "pairs")
    label = merge(shared.select("node", F.col("node").alias("comp")).limit(0), cut(linked(overlaps(pairs, parts)), "links"), shared)
    posts, old = cut(relabelled(posts, label), "posts"), posts
    discard(old, pairs)
    while True:
        keys = cut(active(posts), "active")
        live = cut(posts.join(keys, "g"), "live")
        discard(posts, keys)
        if live.isEmpty():
            return label
        # Small postings: every two members of different components that can link.
        some = live.where(F.col("size") <= few)
        left = some.select("g", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "v", "rest", "must", "comp")])
        right = some.select("g", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "v", "rest", "must", "comp")])
        apart = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.col("must_a") | F.col("must_b"))
        pairs = left.join(right, "g").where(apart & (F.col("v_a") + F.col("v_b") <= scale * F.least("rest_a", "rest_b")))
        pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")).distinct()
        # Large ones: every member and the hub.
        many = live.where(F.col("size") > few)
        meets = cut(many.where("node <> hub.node").select("node", F.col("hub.node").alias("h"), "n", F.col("hub.n").alias("nh"), "typ").distinct(), "meets")
        met = ordered(meets.select(F.col("node").alias("a"), F.col("h").alias("b"), F.col("n").alias("na"), F.col("nh").alias("nb")))
        pairs = cut(pairs.union(met).distinct(), "pairs")
        sums = cut(overlaps(pairs, parts), "sums")
        discard(pairs)
        links = linked(sums)
        if not links.isEmpty():
            label, old = merge(label, links, shared), label
            discard(old)
        if meets.isEmpty():
            return label
        k, union = F.coalesce("k", F.lit(0)), F.col("n") + F.col("nh") - F.coalesce("k", F.lit(0))
        v = (100 + percent) * (F.col("n") + F.col("nh") - 2 * k) - (100 - percent) * F.col("n")
        ends = (F.least("node", "h") == F.col("a")) & (F.greatest("node", "h") == F.col("b"))
        kinds = meets.join(sums.select("a", "b", "k"), ends, "left")
        kinds = cut(kinds.select("node", "h", "n", "nh", "typ", v.alias("v"), (100 * k >= percent * union).alias("linked"), (100 * k < (2 * percent - 100) * union).alias("far")), "kinds")
        # A member far from the hub cannot link with any that links with the hub (Jaccard distances obey the triangle
        # inequality): it stays with those that do not, and meets another hub with them.
        told = many.withColumn("h", F.col("hub.node")).join(kinds.select("node", "h", "linked", "far"), ["node", "h"]).where("not linked")
        told = cut(told.select("g", "node", "n", "typ", "v", "rest", "far"), "told")
        stay = told.join(told.where("far").select("g").distinct(), "g", "left_semi").withColumnRenamed("far", "must")
        posts = cut(relabelled(stay.unionByName(refined(kinds, shared, percent)), label), "posts")
        discard(live, meets, sums, kinds, told)
        few *= 4


def classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, fragments: int = 8, few: int = FEW) -> DataFrame:
    """``id, n_shingles, component_id`` of every row."""
    ids = cut(nodes(df, width, id_col, text_col), "nodes")
    comps = link(candidates(df, ids, width, percent, id_col, text_col), percent, fragments, few)
    # Rows without n-grams, or without an id, keep to themselves.
    alone = ids.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    rows = ids.where("n > 0 and id is not null")
    per_node = cut(rows.groupBy("node").agg(F.min("id").alias("least")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
    smallest = cut(per_node.groupBy("comp").agg(F.min("least").alias("component_id")), "smallest")
    named = per_node.join(smallest, "comp").select("node", "component_id")
    both = rows.join(named, "node").select("id", "n", "component_id").union(alone)
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
