"""Operators that compare documents, URLs or vectors: 4, 6, 7, 9, 10; and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noveltide.llm import fragment_join, ivf_pq, pii, registry, sentence_spans, url_lists
from noveltide.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# --- 4: personal data -------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        doubled = [int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c) for k, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS.items()}


def spans_of(row):
    return {k: [(s.start, s.end) for s in row.spans if s.kind == k] for k in PATTERNS}


ODD = [
    None, "", "a@b.co", "x a@b.co_x@c.de y", "a@b.co@d.ee.ff", "éé a.b%c@x-y.z.w. +1 (555) 123-4567 9", "1.2.3.4.5.6.7.8 300.1.2.3.4 001.002.003.0255",
    "4111 1111 1111 1111 4111-1111-1111-1111-2 4111111111111111", "4111  1111", "+1 2", "+123456789012345678", "+1 555 1234567 - (9) 4111111111111111", "😀 a@b.cd 😀 10.0.0.1",
    "1-4111111111111111 41111111111111111111", "@@a@@b.c", "a" * 5000 + "@b.c", "1." * 3000, "4" * 3000, "+1" + " " * 3000 + "2", "a." * 2000 + "@" + "b." * 2000 + "c", "0.0.0.0000 +44-20-7946-0958.",
]


def test_base_spans(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("a1.@+ -(4é") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], f"{DOCS}, spans string")
    rows = pii.sanitise(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert spans_of(r) == base(r.text)


def brute_terms(rows, p):
    """Term spans (start, end, action) of each (id, text), by the definition."""

    def words(t):
        return {w for w in re.split(r"[\W_]+", t.lower()) if w}

    rows = [(d, t or "") for d, t in rows]
    docs = sorted(set(rows), key=repr)
    held = {d: {(k, d[1][a:z].lower()) for k, s in base(d[1]).items() for a, z in s} for d in docs}
    n, n_e, n_t, n_et = len(docs), Counter(e for d in docs for e in held[d]), Counter(w for d in rows for w in words(d[1])), Counter((e, w) for d in docs for e in held[d] for w in words(d[1]))
    share = {(e, w): math.log(k * min(1, k / p.support) * n / (n_e[e] * max(k, n_t[w]))) / math.log(n / n_e[e]) for (e, w), k in n_et.items() if n_e[e] < n}
    hidden = {w for (_, w), s in share.items() if s >= p.remove}
    out = {}
    for d in docs:
        told = {w for w in words(d[1]) if w in hidden or any(share.get((e, w), 0) >= p.generalise for e in held[d])}
        taken = [s for spans in base(d[1]).values() for s in spans]
        found = [m for m in re.finditer(r"[^\W_]+", d[1]) if m[0].lower() in told and not any(a < m.end() and m.start() < z for a, z in taken)]
        out[d] = [(m.start(), m.end(), "remove" if m[0].lower() in hidden else "generalise") for m in found]
    return out


def terms_of(rows):
    return {(r.doc_id, r.text or ""): [(s.start, s.end, s.action) for s in r.spans if s.kind == "term"] for r in rows}


@pytest.mark.parametrize("support", [1, 3])
def test_terms_against_brute_force(spark, support):
    p = pii.PiiParams(support=support)
    rows = [(k, f"common word{k} zorblax person@mail.example common tail{k} common far away text Zorblax é") for k in range(6)]
    rows += [(k, f"common word{k} other text of no account") for k in range(6, 60)]
    rows += [(60, "zorblax alone in this text"), (60, "zorblax alone in this text"), (61, None), (62, "Quuxly 1987 x9z 12345 and +1 555 1234567 " * 300)]
    got = pii.sanitise(spark.createDataFrame(rows, DOCS), params=p).collect()
    want = brute_terms(rows, p)
    assert terms_of(got) == want and any(want.values())
    assert all(r.clean == (r.text or "") for r in got if not r.spans) and len(got) == len(rows)
    long = next(r for r in got if r.doc_id == 62)
    if support == 3:
        assert {s.action for s in long.spans if s.kind == "term"} == {"generalise"}
        assert long.clean == "[NAME] 1980s [CODE] [NUMBER OF 5 DIGITS] [TERM] [PHONE] " * 300
    else:
        assert long.clean == "     [PHONE] " * 300


def test_terms_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_terms(rows, pii.PiiParams())
    assert terms_of(pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()) == want
    assert sum(map(len, want.values())) > 0


def test_columns_of_any_name_are_kept(spark):
    own = {"email": "mine", "ip": "1", "card": "2", "phone": "3", "_text": "4", "_id": "5", "_th": "6", "_row": "7", "base": "8", "terms": "9", "match": "10"}
    df = spark.createDataFrame([(1, "to a@b.example", *own.values(), "gone", "gone")], ", ".join(f"{c} string" for c in ["doc_id", "text", *own, "spans", "clean"]))
    out = pii.sanitise(df)
    assert out.columns == ["doc_id", "text", *own, "spans", "clean"]
    row = out.first().asDict()
    assert {k: row[k] for k in own} == own and row["clean"] == "to [EMAIL]"


def test_terms_are_removed_and_empty_tables(spark):
    rows = [(k, f"qwv{k} secretname a@b.example") for k in range(4)] + [(k, f"plain text {k}") for k in range(4, 30)]
    out = pii.sanitise(spark.createDataFrame(rows, DOCS)).where("doc_id = 0").first()
    assert out.clean == "qwv0  [EMAIL]"
    assert pii.sanitise(spark.createDataFrame([], DOCS)).count() == 0
    all_ = pii.sanitise(spark.createDataFrame([(1, "x a@b.example"), (None, "x a@b.example"), (1, "x a@b.example")], DOCS)).collect()
    assert len(all_) == 3 and {r.clean for r in all_} == {"x [EMAIL]"}


def test_terms_of_rare_entities(spark):
    """An entity of one document is given away by that document's rare words, however far they stand from it."""
    far = "common words of text " * 40
    rows = [(0, f"zorblax {far} only@one.example {far}"), (1, f"{far} +1 555 1234567 {far} quuxly")] + [(k, f"{far} other{k % 40}") for k in range(2, 1000)]
    rows += [(2000 + k, "secretname thrice@mail.example text") for k in range(5)] + [(3000, "here secretname alone")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    terms = {k: {(rows_text[s.start : s.end], s.action) for s in r.spans if s.kind == "term"} for k, r in out.items() for rows_text in [r.text]}
    assert terms[0] == {("zorblax", "generalise")} and terms[1] == {("quuxly", "generalise")}
    assert all(not terms[k] for k in range(2, 1000))
    # A term that discloses nearly all goes also where the entity is not.
    assert terms[2000] == terms[3000] == {("secretname", "remove")} and out[3000].clean == "here  alone"


# --- 6: sentence spans ------------------------------------------------------------------------------------------


def plain_pieces(text, p):
    """(start, end, words) of the pieces, by plain loops; only a word's hash is taken from the operator."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[\u3041-\u30ff\u4e00-\u9fff\u3001-\u303f]|[^\s\u3041-\u30ff\u4e00-\u9fff\u3000-\u303f]+", text)]
    hashes = [int(sentence_spans.words_of(text[a:z]).hash[0]) for a, z in words]
    ends = set()
    for i, (a, z) in enumerate(words):
        gap = text[z : words[i + 1][0]] if i + 1 < len(words) else text[z:]
        if text[z - 1] in "。！？" or gap and (text[z - 1] in ".!?…" or "\n" in gap) or i + 1 == len(words):
            ends.add(i)
    for i in range(len(words) - p.cut + 1):
        ends.add(max(range(i, i + p.cut), key=lambda j: (-hashes[j], j)))
    out, first = [], 0
    for e in sorted(ends):
        out.append((words[first][0] if out else 0, words[e + 1][0] if e + 1 < len(words) else len(text), [text[a:z].lower() for a, z in words[first : e + 1]]))
        first = e + 1
    return out


def brute_spans(rows, p):
    runs, pieces = defaultdict(set), {}
    for d, t in rows:
        pieces[d] = k = plain_pieces(t or "", p)
        for i in range(len(k)):
            e = i + p.pieces
            while e < len(k) and sum(len(w) for _, _, w in k[i:e]) < p.words:
                e += 1
            if e <= len(k) and sum(len(w) for _, _, w in k[i:e]) >= p.words:
                runs[tuple(w for _, _, ws in k[i:e] for w in ws)].add((d, i, e))
    gone = defaultdict(set)
    for places in runs.values():
        for d, i, e in sorted(places)[1:]:
            gone[d].update(range(i, e))
    out = {}
    for d, t in rows:
        kept = "".join(t[a:z] for i, (a, z, _) in enumerate(pieces[d]) if i not in gone[d]) if t and gone[d] else t
        out[d] = kept.rstrip() if gone[d] and len(pieces[d]) - 1 in gone[d] else kept
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("ab cd ef gh ij 日本。 X.".split()) for _ in range(rng.choice([1, 3, 6, 20]))).capitalize() + "." for _ in range(30)]
    rows = [(k, rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for k in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.text for r in sentence_spans.dedup(df).collect()}
    assert got == brute_spans(rows, sentence_spans.SpanParams())


def test_any_passage_of_fifty_words_is_found(spark):
    """Passages of 50 words, without or with few sentence ends, amid other words and in the middle of sentences."""
    rng = random.Random(1)
    rows = []
    for k in range(60):
        mark = rng.choice(["", ".", ","])
        passage = " ".join(f"p{k}w{rng.randrange(30)}" + (mark if rng.random() < 0.1 else "") for _ in range(50))
        for j in range(2):
            own = [f"o{k}x{j}y{rng.randrange(1000)}" for _ in range(60)]
            rows.append((2 * k + j, " ".join([*own[:30], passage, *own[30:]])))
    out = {r.doc_id: r for r in sentence_spans.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[2 * k].n_removed == 0 and out[2 * k].text == rows[2 * k][1] for k in range(60))
    assert all(out[2 * k + 1].n_removed >= 3 and set(out[2 * k + 1].text.split()) >= set(rows[2 * k + 1][1].split()[:18]) for k in range(60))


def test_odd_span_documents(spark):
    passage = "One sentence has some words in it. Another one follows right behind it. The third is here as well. And a fourth to end."
    rows = [(1, passage, 7), (2, f"Own start here. {passage} Own end there.", 7), (2, f"Own start here. {passage} Own end there.", 7), (3, None, 7), (4, "", 7), (None, None, 7), (5, "x " * 100_000, 7), (6, " \n", 7)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], f"{DOCS}, n_removed int, _id string, _text string, _row string")
    out = sentence_spans.dedup(df)
    assert out.columns == ["doc_id", "text", "_id", "_text", "_row", "n_sentences", "n_removed"]
    got = defaultdict(list)
    for r in out.collect():
        assert (r._id, r._text, r._row) == ("a", "b", "c")
        got[r.doc_id].append((r.text, r.n_removed))
    assert got[1] == [(passage, 0)] and got[2][0] == got[2][1] and got[2][0][0] == "Own start here. Own end there."
    assert got[3] == [(None, 0)] and got[4] == [("", 0)] and got[None] == [(None, 0)] and got[6] == [(" \n", 0)]
    assert len(got[5][0][0]) < 200
    assert sentence_spans.dedup(df.limit(0)).count() == 0


# --- 7: nearest neighbours --------------------------------------------------------------------------------------


def clustered(rng, n, dim):
    """Clusters of very unequal sizes, one of them a third of all, and copies of one vector."""
    centres = rng.normal(size=(40, dim))
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 40, n))
    x = centres[which] + 0.2 * rng.normal(size=(n, dim))
    x[100:160] = x[100]  # equal vectors: ties go to smaller ids
    return x


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000, 16) if kind == "clustered" else rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist(), "c") for k, v in enumerate(x)], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    p = ivf_pq.IvfParams(group_rows=700, block_queries=40)
    for r in ivf_pq.search(df, F.col("id") % 20 == 0, params=p).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    hit = 0
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert len(got[q]) == 20 and q not in dict(got[q])
        assert all(math.isclose(v, s[i], rel_tol=1e-9, abs_tol=1e-9) for i, v in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        least = s[best[-1]]
        hit += sum(s[i] >= least - 1e-9 for i in dict(got[q]))
    assert hit >= 0.9 * len(x)


def test_recall_of_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(set)
    for r in registry.queries()["op7_ivf_pq"](spark, "/root/testdata/sf0.01").collect():
        got[r.query_id].add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    want = {}
    for q in asked:
        s = x @ x[q]
        want[int(ids[q])] = {int(ids[i]) for i in [i for i in np.lexsort((ids, -s)) if i != q][:20]}
    assert got.keys() == want.keys() and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_recall_in_tight_clusters_with_copies(spark):
    """Thousands of near vectors in a cluster, of which codes tell little, and more copies of one than are reranked."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(2, 16))
    x = np.concatenate([centres[rng.integers(0, 2, 3000)] + 1e-3 * rng.normal(size=(3000, 16)), np.repeat(rng.normal(size=(1, 16)), 1000, axis=0)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ivf_pq.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    hit = 0
    for q in range(0, 3000, 50):
        s = (x * x[q]).sum(axis=1)
        hit += len(set(got[q]) & set([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]))
    assert hit >= 0.9 * 20 * 60
    assert all(got[q] == [i for i in range(3000, 3022) if i != q][:20] for q in range(3000, 4000, 50))


def test_probes_are_widened(spark):
    """Queries whose lists hold too few candidates get as many as there are."""
    x = [(k, [1.0, 0.001 * k]) for k in range(0, 400)] + [(1000 + 20 * k, [-1.0, 50.0 * k]) for k in range(3)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = ivf_pq.search(df, F.col("id") >= 1000, params=ivf_pq.IvfParams(target_recall=0.01)).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in got) == [(1000, 20), (1020, 20), (1040, 20)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.25, 0.5]), (20, [3.0]), (27, [-2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = [(r.query_id, r.rank, r.id, r.score) for r in ivf_pq.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 9, 0.5), (0, 3, 1, 0.25), (20, 1, 7, 3.0), (20, 2, 27, -6.0)]
    assert ivf_pq.search(df, F.col("id") == 1).where("id = 1").count() == 2  # two rows of one id find each other
    assert ivf_pq.search(df.where("vec_id = 0"), F.col("id") == 0).count() == 0
    assert ivf_pq.search(df.where("vec_id = 2"), F.col("id") == 2).count() == 0
    assert ivf_pq.search(df.limit(0), F.col("id") == 0).count() == 0


# --- 9: URL lists -----------------------------------------------------------------------------------------------


def test_intervals_and_keys(spark):
    entries = [("l", "A.com ", "2024-01-01", "add"), ("l", "a.com", "2024-02-01", "add"), ("l", "a.com", "2024-03-01", "remove"), ("l", "a.com", "2024-04-01", "remove"), ("l", "a.com", "2024-05-01", "add")]
    entries += [("m", "b.org/x", "2024-01-01", "add"), ("m", "c.org", "2024-01-01", "add"), ("m", "c.org", "2024-01-01", "remove"), (None, "d.org", "2024-01-01", "add"), ("m", None, "2024-01-01", "add"), ("m", "e.org", None, "add")]
    e = spark.createDataFrame(entries, "list string, pattern string, day string, action string")
    got = {(r.list, r.pattern, str(r.valid_from), str(r.valid_to)) for r in url_lists.intervals(e).collect()}
    assert got == {("l", "a.com", "2024-01-01", "2024-03-01"), ("l", "a.com", "2024-05-01", "None"), ("m", "b.org/x", "2024-01-01", "None")}
    urls = [
        (1, "https://www.A.com:80/q?x", "2024-02-28", True), (2, "http://a.com", "2024-03-01", False), (3, "http://u:p@a.com./", "2024-05-01", True), (4, "http://aa.com/", "2024-02-01", False),
        (5, "http://s.b.org/X/y", "2024-02-01", True), (6, "http://b.org/xy", "2024-02-01", False), (7, None, "2024-02-01", False), (8, "http://a.com", None, False), (9, "no url", "2024-02-01", False), (10, "http://c.org", "2024-02-01", False),
        (10, "http://c.org", "2024-02-01", False), (11, "http://a.com/" + "y/" * 20_000, "2024-02-01", True), (None, "http://a.com", "2023-12-31", False),
    ]
    caps = spark.createDataFrame([(*u[:3], "clash") for u in urls], "page_id long, url string, fetched string, blocked string").withColumn("fetched", F.col("fetched").cast("date"))
    out = url_lists.evaluate(caps, e).collect()
    assert sorted(((r.page_id or 0), r.blocked) for r in out) == sorted((u[0] or 0, u[3]) for u in urls)
    assert url_lists.evaluate(caps.limit(0), e).count() == 0
    forms = ["a.com/", "http://b.com", "https://u@c.com:8080/X//y/?q", "d.com.", "//e.com/p/", "[::1]/x", "10.0.0.1", "http://", "/only/path", "mailto:f.com"]
    e2 = spark.createDataFrame([("l", p, "2024-01-01", "add") for p in forms], "list string, pattern string, day string, action string")
    assert {r.pattern for r in url_lists.intervals(e2).collect()} == {"a.com", "b.com", "c.com/x/y", "d.com", "e.com/p", "[::1]/x", "10.0.0.1", "f.com"}
    hits = ["http://a.com", "http://x.a.com/z", "ftp://b.com:21/", "http://C.com/x/Y/z", "http://d.com./", "http://e.com/p", "http://[::1]:80/x/1", "http://u:p@10.0.0.1/"]
    misses = ["http://c.com/x", "http://e.com/pp", "http://[::2]/x", "http://[::1]/", "http://9.10.0.0.1.com", "http://110.0.0.1", "http://aa.com"]
    c2 = spark.createDataFrame([(u, "2024-02-01") for u in hits + misses], "url string, fetched string")
    assert {r.url: r.blocked for r in url_lists.evaluate(c2, e2).collect()} == {u: u in hits for u in hits + misses}
    assert not any(r.blocked for r in url_lists.evaluate(caps, e.limit(0)).collect())


# --- 10: n-gram Jaccard join ------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets_of(rows):
    out = []
    for _, t in rows:
        w = words_of(t)
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_classes(rows):
    sets, label = sets_of(rows), [d for d, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and rows[i][0] is not None and rows[j][0] is not None and 100 * k >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(label):
        least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)]) if d is not None else None) for i, d in enumerate(label)), key=repr)


def classes_of(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"{DOCS}, node int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in fragment_join.classes(df, **kw).collect()), key=repr)


def test_classes_against_brute_force(spark):
    rng = random.Random(6)
    rows, k = [], 0
    for size in (1, 1, 2, 3, 8, 25):  # groups of near copies, each farther from the first
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 80]))]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(50)}"
            if rng.random() < 0.3:
                words = copy
            rows.append((k, rng.choice([" ", "\n\t"]).join(copy)))
            k += 7
    shared = " ".join(f"s{i}" for i in range(40))  # a passage that is most of many short documents
    rows += [(1000 + i, shared + "".join(f" u{i}x{j}" for j in range(4 + i))) for i in range(12)]
    rows += [(rows[3][0] + 1, rows[3][1].upper()), (5000, "a b"), (5001, "A\x0bB"), (5002, "a  b c"), (5003, ""), (5004, None), (5005, " \n"), (None, "a b"), (None, None), (5000, "a b"), (6000, "é É"), (6001, "É É"), (6002, "x y z"), (7000, "r " * 40_000)]
    assert classes_of(spark, rows) == brute_classes(rows)


def test_a_large_group_and_no_rows(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words[: k % 50], f"z{k}", *words[k % 50 + 1 :]])) for k in range(150)]
    assert classes_of(spark, rows) == brute_classes(rows)
    assert classes_of(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_rounds_against_brute_force(spark, seed):
    """Groups whose members lie around the limit, and texts mixed from common passages, through every kind of round."""
    rng = random.Random(seed)
    rows, passages = [], [[f"p{i}x{j}" for j in range(12)] for i in range(6)]
    for group in range(2):
        words = [f"g{group}w{i}" for i in range(80)]
        ways = [[*words] for _ in range(3)]
        for way in ways[1:]:
            for _ in range(3):
                way[rng.randrange(80)] = f"y{rng.randrange(9)}"
        for _ in range(30):
            copy = list(rng.choice(ways))
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(80)] = f"v{rng.randrange(4000)}"
            rows.append(copy)
    rows += [[w for i in rng.sample(range(6), 4) for w in passages[i]] + [f"u{k}x{j}" for j in range(rng.randrange(6))] for k in range(40)]
    rows = [(k, " ".join(words)) for k, words in enumerate(rows)]
    assert classes_of(spark, rows, few=2) == brute_classes(rows)


def test_shingle_sets():
    texts = ["A b c d e f", "a b c d e f", "a b c d e", None, "", "x", "b c d e f"]
    own, h = shingle_sets(texts)
    sets = [set(h[own == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] == sets[2] | sets[6] and [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 1]
    rng = random.Random(9)
    many = [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    own, h = shingle_sets(many)
    names = defaultdict(set)
    for i, s in enumerate(sets_of(list(enumerate(many)))):
        assert len(s) == (own == i).sum()
        names[frozenset(h[own == i].tolist())].add(s)
    assert all(len(v) == 1 for v in names.values())


# --- queries ----------------------------------------------------------------------------------------------------


def test_query_names(spark):
    names = registry.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and len(names) == 13
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda df: sorted((tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in df.astype(object).values.tolist()), key=repr)
    assert key(got) == key(want)


@pytest.mark.parametrize("name", ["op4_pii", "op6_sentence_spans", "op10_fragment_join"])
def test_queries_against_brute_force(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.queries()[name](spark, SF).collect()
    if name == "op4_pii":
        want = {d: hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, s in base(t).items() for a, z in s).encode()).hexdigest() for d, t in rows}
        assert {r.doc_id: r.base_sha256 for r in got} == want
    elif name == "op6_sentence_spans":
        assert {r.doc_id: r.text for r in got} == brute_spans(rows, sentence_spans.SpanParams())
    else:
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_classes(rows)


def test_pipeline(spark):
    import corpus_pipeline as cp
    import sentencepiece

    from noveltide.llm import cgk_decontamination, kernel_langid
    from noveltide.llm.common import read
    from noveltide.llm.q08_sentencepiece import model_path

    docs = read(spark, SF, "documents").select(*cp.COLUMNS)
    one = cp.language_id(spark, docs, SF)
    assert one.columns == docs.columns and one.count() >= 0.98 * docs.count()
    two = cp.near_duplicates(spark, one, SF)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(r.doc_id for r in two.collect()) == sorted(d for d, _, c in brute_classes(rows) if d == c)
    three = cp.decontamination(spark, two, SF)
    leaked = {r.doc_id for r in cgk_decontamination.leaks(two, read(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - leaked
    four = cp.personal_data(spark, three, SF).collect()
    assert len(four) == three.count() and all(not any(base(r.text).values()) for r in four)
    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = {r.doc_id: lib.encode(r.text, add_eos=True) for r in four}
    got = {r.doc_id: list(r.ids) for r in cp.run(spark, SF).collect()}
    assert got == want
    junk = spark.createDataFrame([(1, None, "en", "s", 0), (2, "123", None, None, None)], docs.schema)
    assert kernel_langid.UNDETERMINED == "und" and cp.language_id(spark, docs.unionByName(junk), SF).where("doc_id in (1, 2) and text is null or text = '123'").count() == 0
    assert Counter(name for name, _ in cp.STAGES).most_common(1)[0][1] == 1


def test_language_stage_rejects_what_is_like_no_language(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    rng = random.Random(3)
    junk = [
        "Привет, это обычный русский текст о погоде и о людях.", "日本語の文章です。今日は天気がいいですね。", "هذا نص باللغة العربية عن الطقس والناس",
        "Ez egy magyar nyelvű szöveg az időjárásról és az emberekről.", "qzxv jkwq zzxq vvkj wqxz jqkz xkcd pfft", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(5000)), "Привет, мир. " * 50_000,
    ]
    clean = ["the of and", "las de los", "und der die", "The and!"]
    rows = [(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(junk + clean)]
    kept = cp.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF).where(f"doc_id >= {10**6}").collect()
    assert sorted(r.text for r in kept) == sorted(clean)


def test_every_stage_on_odd_documents(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names the operators use."""
    import corpus_pipeline as cp

    own = {c: c for c in ("_text", "_id", "_row", "_th", "_key", "node", "id", "n", "spans", "clean", "lang_pred", "score", "known_share", "_stays", "ids", "component_id")}
    learn = [(100 + k, t, lang, "s", len(t)) for k in range(8) for lang, t in (("en", f"the of and to in is that for it was on n{k} " * 3), ("de", f"der die das und ist nicht ein eine n{k} " * 3))]
    long = " ".join(f"the of and w{k}" for k in range(60_000))
    odd = [(None, "the of and to in is that by null", None, "s", 32), (None, None, "en", "s", None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 456", "en", "s", 7), (4, long, None, "s", len(long)), (5, "the of and to in is that me@x.example once", "en", "s", 42), (5, "the of and to in is that me@x.example once", "en", "s", 42)]
    odd += [(6, "the of and to in is that for it was on it all again and more", "en", "s", 60), (7, "the of and to in is that for it was on it all again and more", "en", "s", 60)]
    docs = spark.createDataFrame([(*r, *own.values()) for r in learn + odd], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{c} string' for c in own)}")
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in own), name
        docs = spark.createDataFrame(rows, out.schema)
        if name == "language_id":
            assert {r.doc_id for r in rows} & {1, 2, 3, 4, 5, 6, 7} == {4, 5, 6, 7} and any(r.doc_id is None and r.lang == "en" for r in rows) and len(rows) == before - 4
        if name == "near_duplicates":
            assert [r.doc_id for r in rows].count(5) == 1 and 7 not in {r.doc_id for r in rows} and any(r.doc_id is None for r in rows)
        if name == "personal_data":
            five = next(r for r in rows if r.doc_id == 5)
            assert "[EMAIL]" in five.text and "@" not in five.text and five.n_chars == len(five.text) and len(rows) == before
    last = cp.token_ids(spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and last.count() == docs.count()


def test_empty_tables_pass_through_every_stage(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if set(cp.COLUMNS) <= set(out.columns) else docs


def test_the_least_known_share_counts_every_row(spark):
    """More rows than a language teaches with: the few odd ones among all of them move the threshold."""
    from noveltide.llm import kernel_langid

    p = kernel_langid.KernelParams(per_lang=5)
    words = "the quick brown fox jumps over a lazy dog and runs"
    learned = spark.createDataFrame([(k, words, "en") for k in range(5)], "doc_id long, text string, lang string")
    model = kernel_langid.fit(learned, params=p)
    rows = [(k, words if k % 5 else "zzz xxx qqq vvv", "en") for k in range(100)] + [(100, None, "en"), (101, "zz", None)]
    left = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shares = sorted(r.known_share for r in kernel_langid.predict(left.where("doc_id < 100"), model).collect())
    assert abs(kernel_langid.least_known(model, left) - 2 / 3 * shares[4]) < 1e-4
    same = spark.createDataFrame([(k, words, "en") for k in range(4000)], "doc_id long, text string, lang string")
    few = spark.createDataFrame([(k, "zzz xxx qqq", "en") for k in range(4000, 4300)], "doc_id long, text string, lang string")
    low = kernel_langid.predict(few.limit(1), model).first().known_share
    assert abs(kernel_langid.least_known(model, same.unionByName(few)) - 2 / 3 * low) < 1e-4
