"""Repeated ids, hot days, files with different headers, exact quantiles, phrases by their rarest word."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from noveltide.operators import novelty, phrases, preprocess, reports, vectors
from noveltide.sources import files

TOKENS = "eid string, tokens array<string>"


# --- rows that share an id --------------------------------------------------------------------------------------


def test_bigrams_of_repeated_ids(spark):
    rows = [("a", ["new", "york", "x"]), ("a", ["x", "y", "z", "w"]), ("a", ["x", "y", "z", "w"]), (None, ["new", "york"]), ("b", None), ("b", [])]
    known = spark.createDataFrame([("new", "york")], "a string, b string")
    got = sorted((r.eid or "", r.tokens) for r in phrases.apply(spark.createDataFrame(rows, TOKENS), known).collect() if r.tokens)
    assert got == [("", ["new_york"]), ("a", ["new_york", "x"]), ("a", ["x", "y", "z", "w"]), ("a", ["x", "y", "z", "w"])]


def test_means_of_repeated_ids(spark):
    rows = [("a", ["k", "u", "k"]), ("a", ["k", "u", "u", "u"]), ("a", ["k", "u", "u", "u"]), (None, ["m"]), ("b", None), ("b", []), ("c", ["u", None])]
    words = spark.createDataFrame([("k", [1.0, 2.0]), ("m", [0.0, 4.0])], "word string, vector array<float>")
    df = spark.createDataFrame(rows, TOKENS)
    got = sorted((r.eid or "", round(r.coverage_ratio, 4), r.vector) for r in vectors.mean_vectors(df, words, 2).collect())
    assert got == [("", 1.0, [0.0, 4.0]), ("a", 0.25, [1.0, 2.0]), ("a", 0.25, [1.0, 2.0]), ("a", 0.6667, [1.0, 2.0]), ("b", 0.0, [0.0, 0.0]), ("b", 0.0, [0.0, 0.0]), ("c", 0.0, [0.0, 0.0])]
    assert sorted((r.eid or "", round(r.coverage_ratio, 4)) for r in vectors.coverage(df, words).collect()) == [g[:2] for g in got]


def test_means_send_a_row_once(spark):
    """Texts meet their words in one step; what else stands in a row, nulls among tokens, and copies come out as they were."""
    rows = [("a", ["k", None, "é", ""], 1, {"x": 1}), ("a", ["k", None, "é", ""], 2, {"x": 1}), ("a", ["k", None, "é", ""], 2, {"x": 1}), ("b", None, None, None), (None, [], 3, {})]
    df = spark.createDataFrame(rows, "eid string, tokens array<string>, year int, more map<string, int>")
    words = spark.createDataFrame([("k", [3.0]), ("é", [6.0]), ("", [0.0])], "word string, vector array<float>")
    out = vectors.mean_vectors(df, words, 1)
    got = sorted(((r.eid or "", r.tokens, r.year, r.more, r.coverage_ratio, r.vector) for r in out.collect()), key=str)
    ratios = {"a": (1.0, [3.0]), "b": (0.0, [0.0]), "": (0.0, [0.0])}
    assert got == sorted([(k or "", t, y, m, *ratios[k or ""]) for k, t, y, m in rows], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # words of shards with their vectors; rows are joined with nothing
    assert vectors.mean_vectors(df.select("eid", F.split(F.lit("k é"), " ").alias("tokens")), words, 1).where("coverage_ratio = 1 and vector[0] = 4.5").count() == 5


@pytest.mark.parametrize("dim", [200, 768])
def test_means_in_full_size(spark, dim):
    rng = random.Random(dim)
    table = {w: [rng.uniform(-1, 1) for _ in range(dim)] for w in "abc"}
    tokens = list("aabcx")
    words = spark.createDataFrame(list(table.items()), "word string, vector array<float>")
    got = vectors.mean_vectors(spark.createDataFrame([("d", tokens)], TOKENS), words, dim)
    row = got.first()
    assert row.coverage_ratio == 0.8 and len(row.vector) == dim
    assert all(math.isclose(x, sum(table[w][j] for w in "aabc") / 4, abs_tol=1e-6) for j, x in enumerate(row.vector))


def test_phrases_of_repeated_ids(spark):
    df = spark.createDataFrame([("a", ["Alpha", "beta", "gamma"]), ("a", ["gamma", "alpha"])], TOKENS)
    out = preprocess.phrases_first(df, spark.createDataFrame([("alpha beta",)], "phrase string"))
    assert sorted(r.tokens for r in out.collect()) == [["alpha_beta", "gamma"], ["gamma", "alpha"]]


# --- the index --------------------------------------------------------------------------------------------------


def index_rows(rows, years):
    """(id, score, sizes) of each row by its definition; rows are (id, day, tie, vector)."""
    window, near = int(years * 365.25), years * 365.25
    rows = sorted((d.toordinal(), k, t, v) for k, d, t, v in rows)

    def unit(v):
        n = max(math.sqrt(sum(x * x for x in v)), 1e-12)
        return [x / n for x in v]

    us, out = [unit(r[3]) for r in rows], []
    for t, (d, k, _, _) in enumerate(rows):
        if rows[0][0] + near <= d <= rows[-1][0] - near:
            pools = [[i for i in range(t) if rows[i][0] >= d - window], [i for i in range(t + 1, len(rows)) if rows[i][0] <= d + window]]
            s = [max(sum((sum(a * b for a, b in zip(us[t], us[i])) + 1) / 2 for i in p), 1e-9) if p else 1e-9 for p in pools]
            out.append((k, round(math.log(s[1] / s[0]), 8), len(pools[0]), len(pools[1])))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_hot_days_and_repeated_ids(spark, block, monkeypatch):
    rng = random.Random(block)
    start = date(2000, 1, 1)
    rows = [(f"e{rng.randrange(40):02d}", start + timedelta(days=rng.choice([0, 400, 500, 500, 500, 500, 900, 1000])), k, [rng.uniform(-1, 1) for _ in range(3)]) for k in range(160)]
    df = spark.createDataFrame(rows, "eid string, cover_date date, key int, vector array<double>")
    monkeypatch.setattr(novelty.pools, "__defaults__", (block,))
    got = sorted((r.eid, round(r.ki_score, 8), r.past_pool_size, r.future_pool_size) for r in novelty.index(df, 1, tie_col="key").collect())
    want = index_rows(rows, 1)
    assert len(got) == len(want) > 60
    for g, w in zip(got, want, strict=True):
        assert (g[0], *g[2:]) == (w[0], *w[2:]) and math.isclose(g[1], w[1], abs_tol=1e-7)
    # Without the column, rows of one day and id are ordered by their vectors: each still has a place of its own.
    assert sorted((r.past_pool_size, r.future_pool_size) for r in novelty.index(df, 1).collect()) == sorted(w[2:] for w in want)


def test_a_hot_day_runs_in_several_tasks(spark):
    df = spark.range(60_000).select(F.col("id").alias("eid"), F.lit("2001-01-01").alias("cover_date"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("vector"))
    blocks = novelty.in_blocks(novelty.prepare(df), 1000).groupBy("ord", "block").agg(F.count("*").alias("n"), F.min("eid").alias("lo"), F.max("eid").alias("hi")).orderBy("block").collect()
    assert 30 < len(blocks) < 120 and sum(b.n for b in blocks) == 60_000 and max(b.n for b in blocks) < 12_000
    assert all(a.hi < b.lo for a, b in zip(blocks, blocks[1:], strict=False))
    few = novelty.in_blocks(novelty.prepare(df), 10, 20).agg(F.count_distinct("block").alias("n")).first().n
    assert 5 < few < 50
    got = novelty.pools(novelty.prepare(df), 1, 1000).agg(F.sum("past_pool_size").alias("p"), F.sum("future_pool_size").alias("f"), F.max("past_pool_size").alias("m")).first()
    assert got.p == got.f == 60_000 * 59_999 // 2 and got.m == 59_999


def test_metadata_of_repeated_ids_multiply(spark):
    meta = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "v")], "eid string, title string")
    scores = spark.createDataFrame([("a", 0.5, 1, 2), ("a", 0.6, 2, 1)], "eid string, ki_score double, past_pool_size long, future_pool_size long")
    assert sorted((r.title, r.ki_score) for r in novelty.with_metadata(meta, scores).collect()) == [("t", 0.5), ("t", 0.6), ("u", 0.5), ("u", 0.6)]


# --- files ------------------------------------------------------------------------------------------------------


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('eid,title,doi\n1,"One, ""the"" first",d1\n2,Two\n3,Three,d3,too,many\n')
    (tmp_path / "b.csv").write_text('eid,doi,title\n4,d4,"Four\nlines"\n')
    (tmp_path / "c.csv").write_text("eid,title\n5,Five\n6,Six,\"a,b\"\n")
    (tmp_path / "d.csv").write_text("eid,title,doi\n7,Seven,d7\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text("idioma,venue,eid\nen,V,8\n")
    rows, misfits = files.read_union(spark, str(tmp_path / "*.csv"))
    assert rows.columns == ["eid", "title", "doi", "venue"]
    want = [("1", 'One, "the" first', "d1", ""), ("2", "Two", "", ""), ("4", "Four\nlines", "d4", ""), ("5", "Five", "", ""), ("7", "Seven", "d7", ""), ("8", "", "", "V")]
    assert sorted(map(tuple, rows.collect())) == want
    assert sorted((r.file.rsplit("/", 1)[1], r.record.strip()) for r in misfits.collect()) == [("a.csv", "3,Three,d3,too,many"), ("c.csv", '6,Six,"a,b"')]
    assert rows.select("doi").where("doi <> ''").count() == 3 and misfits.count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_union(spark, str(tmp_path / "e.csv"))


# --- quantiles --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [1, 7, 10_000])
@pytest.mark.parametrize("kind", ["random", "ties", "one", "skewed"])
def test_exact_quantiles(spark, few, kind):
    rng = random.Random(few)
    draw = {"random": rng.random, "ties": lambda: float(rng.randrange(3)), "one": lambda: 4.0, "skewed": lambda: rng.choice([0.0, 0.0, 0.0, 10 ** rng.uniform(-300, 300), -rng.random()])}[kind]
    df = spark.createDataFrame([(draw(),) for _ in range(3000)] + [(None,)], "x double")
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    want = df.select(F.percentile("x", F.array(*map(F.lit, probs)))).first()[0]
    assert reports.exact_quantiles(df, "x", probs, few) == pytest.approx(want, rel=1e-12)


def test_quantiles_of_little(spark):
    assert reports.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]
    assert reports.exact_quantiles(spark.createDataFrame([(1,), (2,)], "x int"), "x", [0.5, 1.0]) == [1.5, 2.0]


# --- phrases ----------------------------------------------------------------------------------------------------


def test_phrases_meet_by_their_rarest_word(spark):
    df = spark.createDataFrame([(str(k), ["the", "big", "the", "whale" if k == 3 else "sea"]) for k in range(20)], TOKENS)
    entries = spark.createDataFrame([("the whale",), ("the big the",), ("never seen",)], "phrase string")
    found = preprocess.anchors(df.withColumn("_low", F.transform("tokens", F.lower)), entries)
    assert {(r.phrase, r.w, r["shift"]) for r in found.collect()} == {("the_whale", "whale", 1), ("the_big_the", "big", 1)}
    got = {r.eid: r.tokens for r in preprocess.phrases_first(df, entries).collect()}
    assert got["3"] == ["the_big_the", "whale"] and got["4"] == ["the_big_the", "sea"]


def test_words_inside_phrases_are_not_discarded(spark):
    df = spark.createDataFrame([("1", ["ring", "of", "the", "x9y9"])], TOKENS)
    parted = preprocess.with_phrases(df, spark.createDataFrame([("ring of",)], "phrase string"))
    assert {(r.palabra, r.motivo) for r in preprocess.discard_log(parted, "_rest").collect()} == {("the", "stopword"), ("x9y9", "no_alpha")}
    assert preprocess.cleaned(parted).first().tokens == ["ring_of"]


def test_means_by_shards(spark):
    """A word's vector is drawn once by each shard of rows; rows that are alike, empty and unknown ones included."""
    from noveltide.operators import vectors

    docs = [(1, ["a", "b", "a", "x"]), (1, ["b"]), (2, []), (3, None), (4, ["x", None]), (1, ["b"]), (None, ["a", None, "b"]), *[(k, ["a", "b", "b"] * 9) for k in range(5, 12)]]
    df = spark.createDataFrame(docs, "eid long, tokens array<string>")
    words = spark.createDataFrame([("a", [1.0, -2.0]), ("b", [3.0, 0.5])], "word string, vector array<float>")
    known = {"a": (1.0, -2.0), "b": (3.0, 0.5)}

    def want(tokens):
        all_, hit = [t for t in tokens or [] if t is not None], [known[t] for t in tokens or [] if t in known]
        return (len(hit) / len(all_) if all_ else 0.0), [sum(v[j] for v in hit) / len(hit) if hit else 0.0 for j in range(2)]

    for many in (10, 10**6):
        out = vectors.mean_vectors(df, words, 2, shard_tokens=many)
        got = [(r.eid, r.tokens, round(r.coverage_ratio, 6), [round(x, 5) for x in r.vector]) for r in out.collect()]
        expected = [(i, t, round(want(t)[0], 6), [round(x, 5) for x in want(t)[1]]) for i, t in docs]
        assert sorted(map(str, got)) == sorted(map(str, expected))


def test_phrases_go_to_the_tokens(spark):
    """Tokens are not dealt out by word: all of a frequent one would meet in one task."""
    from noveltide.operators import preprocess

    df = spark.createDataFrame([(k, ["the", "ring", "gear"]) for k in range(9)], "eid long, tokens array<string>")
    out = preprocess.with_phrases(df, spark.createDataFrame([("ring gear",)], "phrase string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(w#" in x and "posexplode" in x]
    assert plan.count("BroadcastHashJoin") >= 2
    assert {tuple(r._phrases) for r in out.collect()} == {("ring_gear",)}


def test_texts_keep_the_letter_v(spark):
    """The SQL of compose_text trims it: in DuckDB, the escape for a vertical tab is the letter v."""
    from noveltide.operators import langid

    row = spark.createDataFrame([("vequ", "avec v\x0b ")], "t string, a string").select(langid.compose(F.col("t"), F.col("a")).alias("x")).first()
    assert row.x == "vequ. avec v"


def counted_by_hand(docs):
    words, pairs = {}, {}
    for t in docs:
        for w in t or []:
            words[w] = words.get(w, 0) + 1
        for p in zip(t or [], (t or [])[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    return words, pairs


def test_words_and_pairs_are_counted_together(spark, monkeypatch):
    """One pass over the texts, in blocks: pairs never reach over the end of a document, nulls count as a word."""
    import pyarrow as pa

    rng = random.Random(8)
    docs = [[rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(0, 9))] for _ in range(50)] + [None, []]
    monkeypatch.setattr(phrases, "BLOCK", 20)
    monkeypatch.setattr(phrases, "RETURNED", 3)
    batches = [pa.record_batch([pa.array(docs[k : k + 7], pa.list_(pa.string()))], names=["tokens"]) for k in range(0, len(docs), 7)]
    words, pairs = {}, {}
    for out in phrases.count(iter(batches)):
        for r in out.to_pylist():
            into, key = (pairs, (r["a"], r["b"])) if r["pair"] else (words, r["a"])
            into[key] = into.get(key, 0) + r["n"]
    assert (words, pairs) == counted_by_hand(docs)
    assert not list(phrases.count(iter([pa.record_batch([pa.array([None, []], pa.list_(pa.string()))], names=["tokens"])])))


def test_bigrams_are_learned_in_one_reading(spark):
    """What is learned is a written table: using it reads no text again."""
    docs = [(str(k), ["x", "new", "york", "y"] if k % 2 else ["new", "york", None]) for k in range(10)]
    learned = phrases.learn(spark.createDataFrame(docs, TOKENS), min_count=5, threshold=0.1)
    words, pairs = counted_by_hand([t for _, t in docs])
    got = {(r.a, r.b): (r.n_ab, r.score) for r in learned.collect()}
    assert got == {("new", "york"): (10, pytest.approx((10 - 5) / 10 / 10 * (len(words) + len(pairs))))}
    plan = learned._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("id_col", ["eid", "key"])
def test_bigrams_go_to_the_shards(spark, id_col):
    """Pairs of neighbours do not travel, in as many shards as there are; other columns and nulls stay."""
    rng = random.Random(9)
    known = {("a", "b"), ("b", "a"), ("c", "c"), ("a", "zz")}
    docs = [(k % 5, k, [rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(0, 30))], float(k)) for k in range(60)] + [(1, 99, None, 0.0)]
    df = spark.createDataFrame(docs, f"{id_col} long, k long, tokens array<string>, x double")

    def want(t):
        out, k = [], 0
        while k < len(t):
            two = k + 1 < len(t) and (t[k], t[k + 1]) in known
            out.append(f"{t[k]}_{t[k + 1]}" if two else t[k])
            k += 1 + two
        return out

    for tokens in (10, 10**6):
        merged = phrases.apply(df, spark.createDataFrame(list(known), "a string, b string"), id_col, shard_tokens=tokens)
        assert {r.k: (r[0], r.tokens, r.x) for r in merged.collect()} == {k: (i, None if t is None else want(t), x) for i, k, t, x in docs}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan
