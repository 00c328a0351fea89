"""Operators 11 to 13."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noveltide.llm import anagrams, mixing, q12_anagrams, vbm_wand

SF = "/root/testdata/sf0.001"


# --- 11: mixing -------------------------------------------------------------------------------------------------


def filled(sizes, weights, share, most):
    """Targets by handing out shares and handing the excess out again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, got = set(), {}
    while True:
        left, rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        got = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        above = {s for s in names if s not in full and got[s] >= most * sizes[s]}
        if not above:
            return got
        full |= above


def mixed_rows(rng, sources, n):
    return [(rng.randrange(n), rng.choice(sources), " ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 3, 9, 40])))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "block", "shard"), [(1, 8, 4), (2, 5, 16)])
def test_mix_meets_its_targets(spark, seed, block, shard):
    rng = random.Random(seed)
    rows = [*mixed_rows(rng, ["a", "b", "B", "é", "", None], 150), (1, "hot", "x y " * 700), (2, "hot", None), (3, "blank", " \t"), (4, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("other")).withColumn("taken", F.lit(1))
    m = mixing.mix(df, (3.0, 1.0, 2.0), block=block, shard=shard)
    got = mixing.taken(m).collect()
    assert sorted((r.id, r.source or "", r.size) for r in got) == sorted((i, s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = filled(sizes, (3, 1, 2), 1.5, 2)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    # The output itself: every slot once, of one block's words, and the texts are what was counted.
    slots = m.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) and all(0 < r.words <= block and 0 <= r.slot < shard for r in slots)
    texts = mixing.texts(m, df).collect()
    assert all(len(r.text.split(" ")) == r.words for r in texts) and sum(r.words for r in texts) == sum(taken.values())
    words = defaultdict(Counter)
    for r in texts:
        words[r.source].update(r.text.split(" "))
    assert words["hot"].keys() == {"x", "y"}
    assert [r.taken for r in sorted(got, key=repr)] == [r.taken for r in sorted(mixing.taken(mixing.mix(df.repartition(3), (3.0, 1.0, 2.0), block=block, shard=shard)).collect(), key=repr)]


def test_shards_have_multinomial_counts(spark):
    rows = [(k, "ab"[k % 2], "w " * 40) for k in range(1000)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), (1.0, 1.0), block=4, shard=500)
    counts = [r["n"] for r in m.slots.where("s = 1").groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 30 and len(set(counts)) > 8 and all(abs(n - 250) < 5 * math.sqrt(125) for n in counts)


def test_given_weights(spark):
    rows = [(k, s, "w " * 10) for k, s in enumerate([*"aabbbcccc", None])]
    weights = spark.createDataFrame([("a", 1.0), (None, 1.0), ("b", 0.0), ("c", None)], "source string, weight double")
    got = mixing.taken(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights, share=0.2, block=3)).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert by == {"a": 10, None: 10, "b": 0, "c": 0}


def test_nothing_to_mix(spark):
    for rows in ([], [(1, "a", None), (2, None, "")]):
        m = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), (3.0, 1.0, 2.0))
        assert [(r.size, r.target, r.taken) for r in mixing.taken(m).collect()] == [(0, 0.0, 0)] * len(rows)
        assert mixing.texts(m, spark.createDataFrame(rows, "doc_id long, source string, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100])
def test_permutations(spark, n):
    got = spark.range(n).select(*[mixing.permuted(F.col("id"), F.lit(n), "t", F.lit(k)).alias(f"p{k}") for k in range(3)]).collect()
    assert all(sorted(r[k] for r in got) == list(range(n)) for k in range(3))
    assert n < 17 or len({tuple(r[k] for r in got) for k in range(3)}) == 3


# --- 12: spelling variants --------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, factor=2):
    forms = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w] = (best if best is not None and n[best] >= factor * n[w] else None, len(others))

    def root(w):
        while forms[w][0] is not None:
            w = forms[w][0]
        return w

    return {(w, f, root(w), n[w], k, n.get(f)) for w, (f, k) in forms.items()}


def variants_of(spark, n, factor=2):
    got = anagrams.variants(spark.createDataFrame(list(n.items()), "word string, n long"), factor).collect()
    assert len(got) == len(n)
    return {tuple(r) for r in got}


def test_variants_against_brute_force(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for letters in ("ab", "abc", "aàÿ×é", "ab1ж😀") for _ in range(120)}
    words |= {"a" * k for k in range(1, 9)} | {"x" * 5000, "x" * 4999, "x" * 2500 + "y" + "x" * 2499}
    n = {w: rng.choice([1, 2, 3, 4, 8, 9, 40]) for w in sorted(words)}
    assert variants_of(spark, n) == brute_variants(n)
    assert variants_of(spark, n, 1.5) == brute_variants(n, 1.5)


def test_chains_and_nothing(spark):
    n = {"w" * 20 + "abcdefghijklmnop"[:k]: 2**k for k in range(17)}
    assert {r[2] for r in variants_of(spark, n)} == {max(n, key=n.get)}
    assert variants_of(spark, {}) == set() and variants_of(spark, {"alone": 3}) == {("alone", None, "alone", 3, 0, None)}


def test_no_side_of_the_vocabulary_is_broadcast(spark):
    """A small file of words has many keys, which Spark would send through the driver."""
    vocab = spark.createDataFrame([("abcdef", 9), ("abcdeg", 3)], "word string, n long")
    plan = anagrams.near_pairs(vocab)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_words_that_lose_a_letter(spark):
    rng = random.Random(97)
    rows = [(k, " ".join("".join(rng.choices("abcÉéÿ×Z_1", k=rng.randrange(1, 9))) for _ in range(300))) for k in range(20)]
    df = spark.createDataFrame([*rows, (1, "Straße straße"), (None, "of no id"), (3, None), (4, "")], "doc_id long, text string").withColumn("word", F.lit("x"))
    want = Counter()
    for i, t in [*rows, (1, "Straße straße"), (None, "of no id")]:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32((f"{i}:{w}" if i is not None else w).encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    spoilt = q12_anagrams.spoilt(anagrams.runs(df))
    assert {r.word: r["count"] for r in spoilt.groupBy("word").count().collect()} == want
    vocab = {r.word: r.n for r in anagrams.vocabulary(spoilt, 2, 4).collect()}
    assert vocab == {w: k for w, k in want.items() if len(w) >= 2 and k >= 4}


# --- 13: ranked search ------------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(vbm_wand.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(docs, items, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for item, text in items:
        scores = []
        for (i, b), size in zip(bags, sizes, strict=True):
            s = 0
            for w, times in Counter(plain_terms(text)).items():
                if b[w]:
                    s += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * (25 + 75 * size * n // words)))
            if s:
                scores.append((-s, i is None, i or 0))
        out[item] = [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize(("shard_words", "pass_terms", "k"), [(400, 1000, 10), (50, 7, 3), (100_000, 20, 1)])
def test_ranking_against_brute_force(spark, shard_words, pass_terms, k):
    rng = random.Random(k)
    vocab = [f"w{j}" for j in range(40)] + ["É", "é", "日本", "WORD", "a_b", "0"]
    weights = [1 / (j + 1) for j in range(len(vocab))]
    docs = [(rng.randrange(200), " ".join(rng.choices(vocab, weights, k=rng.choice([1, 5, 30])))) for _ in range(250)]
    docs += [(7, "w1 w2"), (7, "w1 w2"), (8, "w1 w2"), (None, "w1 w2"), (9, None), (10, ""), (11, " .,-"), (12, "w3 " * 3000), (13, "w0,W0;w0")]
    items = [(j, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12])))) for j in range(25)] + [(100, None), (101, "unheard of"), (102, "w5 w5 W5"), (103, "w1.w2"), (103, "w1.w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("ids", F.lit("x"))
    found = vbm_wand.search(vbm_wand.build(df, shard_words=shard_words), spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(0)), k, pass_terms=pass_terms)
    got = defaultdict(list)
    for r in found.collect():
        got[r.item].append((r["rank"], r.id, r.score))
    assert {i: sorted(r) for i, r in got.items()} == brute_ranking(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    assert vbm_wand.search(vbm_wand.build(docs), items).count() == 0
    assert vbm_wand.search(vbm_wand.build(some), items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in vbm_wand.search(vbm_wand.build(some), items).collect()] == [(1, 1, 1)]


def test_long_texts_have_the_same_terms():
    text = "Wörter und 数字 x1 " * 300_000
    own, h = vbm_wand.terms_of([text])
    assert len(h) == 1_200_000 and not own.any() and (h[:4] == vbm_wand.terms_of(["Wörter", "und", "数字", "x1"])[1]).all() and (h.reshape(-1, 4) == h[:4]).all()


@pytest.mark.parametrize(("cost", "longest", "segment"), [(10, 64, 256), (40, 5, 256), (0, 64, 256), (25, 8, 16)])
def test_blocks_are_the_best(cost, longest, segment):
    rng = np.random.default_rng(cost)
    lists = [rng.integers(1, 60, size) for size in [1, 1, 2, 3, 7, 20, 40, 0, 33]]
    ends = vbm_wand.block_ends(np.concatenate(lists).astype(np.int64), np.array([len(x) for x in lists if len(x)]), cost, longest, segment)
    at = 0
    for x in lists:
        mine, at = np.flatnonzero(ends[at : at + len(x)]) + 1, at + len(x)
        for begin in range(0, len(x), segment):
            part = x[begin : begin + segment]
            cuts = [0, *[e - begin for e in mine if begin < e <= begin + len(part)]]
            least = [0]
            for i in range(1, len(part) + 1):
                least.append(min(least[i - b] + b * int(part[i - b : i].max()) + cost for b in range(1, min(i, longest) + 1)))
            spent = sum((b - a) * int(part[a:b].max()) + cost for a, b in zip(cuts, cuts[1:], strict=False))
            assert cuts[-1] == len(part) and spent == least[-1] and max(np.diff(cuts)) <= longest


def test_blocks_are_skipped():
    rng = np.random.default_rng(13)
    n, docs = 20_000, [np.flatnonzero(rng.random(20_000) < p) for p in (0.5, 0.3, 0.002)]
    values = [rng.integers(300_000, 400_000, len(d)) for d in docs]
    rows = {"shard": ["s"] * 4, "term": [1, 2, 3, None], "docs": [*docs, None], "impacts": [*values, None], "ends": [*[np.flatnonzero(vbm_wand.block_ends(v, np.array([len(v)]))) + 1 for v in values], None], "ids": [None, None, None, np.arange(n)]}
    kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
    shard = vbm_wand.Shard(pa.table({c: pa.array(x, k) for (c, x), k in zip(rows.items(), kinds, strict=True)}))
    weights = np.array([10, 300, 9000])
    score = np.zeros(n, np.int64)
    for d, v, w in zip(docs, values, weights, strict=True):
        score[d] += w * v
    want = sorted(((int(s), int(d)) for d, s in enumerate(score)), key=lambda x: (-x[0], x[1]))[:10]
    assert shard.best(np.array([1, 2, 3]), weights, 10) == want
    assert shard.read < 0.2 * sum(map(len, docs))
