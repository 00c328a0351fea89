from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from noveltide import cli
from noveltide.config import Credentials, HarvestConfig, Layout
from noveltide.functions import text as T
from noveltide.operators import enrich, langid, manifests, novelty, phrases, preprocess, reports, vectors, word2vec
from noveltide.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


# --- texts ------------------------------------------------------------------------------------------------------


def test_white_space_of_any_kind(spark):
    assert one(spark, T.strip(F.col("a")), a="\t  x y \n") == "x y"
    assert one(spark, T.strip(F.col("a")), a=None) == ""
    assert [one(spark, T.word_count(F.col("a")), a=a) for a in ("", " ", " a b  c\n", None)] == [0, 0, 3, 0]


def test_nfkc_and_seconds(spark):
    assert one(spark, T.nfkc(F.col("a")), a="ﬁＡ") == "fiA"
    assert one(spark, T.nfkc(F.col("a")), a=None) is None
    assert one(spark, T.hms(F.col("a")), a=3725) == "1h 2m 5s"
    assert one(spark, T.decade_file(F.col("a")), a=1999) == "articles_1990_1999.csv"


# --- language ---------------------------------------------------------------------------------------------------


def test_language_filter(spark):
    english = "the theory of sets and the study of groups is for all of us"
    data = [
        (1, "The title of it", english),
        (2, "El titulo de la casa", english),
        (3, "The title", "three words only"),
        (4, None, english),
        (5, "The title", None),
        (6, "The title", "el la los de que y en un una the of and is"),
    ]
    df = langid.detect(spark.createDataFrame(data, "eid long, title string, abstract string"))
    ok, other = langid.split(df)
    assert [r.eid for r in ok.collect()] == [1]
    assert ok.first().text == f"The title of it. {english}"
    got = {r.eid: (r.lang_abstract, r.lang_title) for r in other.collect()}
    assert got == {2: ("en", "es"), 3: ("", ""), 4: ("en", ""), 5: ("", ""), 6: ("es", "")}
    summary = {r.idioma: (r.abstract_count, r.titulo_count) for r in reports.count_languages(df).collect()}
    assert summary == {"en": (3, 1), "es": (1, 1), "(sin_deteccion)": (2, 4), "TOTAL": (6, 6)}
    with pytest.raises(ValueError, match="missing"):
        langid.detect(spark.createDataFrame([(1,)], "eid long"))


def test_no_undetected_row_if_all_are_detected(spark):
    df = spark.createDataFrame([("en", "en")], "lang_abstract string, lang_title string")
    assert {r.idioma for r in reports.count_languages(df).collect()} == {"en", "TOTAL"}


# --- tokens -----------------------------------------------------------------------------------------------------


def test_boilerplate(spark):
    dirty = "A © 2020 TOUS DROITS RÉSERVÉS  theorem. Springer-Verlag"
    assert one(spark, preprocess.clean_boilerplate(F.col("a")), a=dirty) == "A 2020 theorem. -"


@pytest.mark.parametrize(
    ("token", "reason"),
    [("x2", None), ("2x", None), ("abc_12", None), ("abcd_1", "no_alpha"), ("R", None), ("r", "sigla_corta"), ("the", "stopword"), ("x123", "no_alpha"), ("group", None), ("-", "no_alpha"), ("ab", "sigla_corta")],
)
def test_discard_reasons(spark, token, reason):
    assert one(spark, preprocess.discard_reason(F.col("a")), a=token) == reason


def test_white_list_wins_and_phrases_come_first(spark):
    assert one(spark, preprocess.kept_lemmas(F.col("a"), ["the", "r"]), a=["The", "r", "of", "Group"]) == ["the", "r", "group"]
    phrases_ = spark.createDataFrame([(x,) for x in ("lie group", "group action", "lie_group_action", "topology", "a a")], "phrase string")
    docs = spark.createDataFrame([(1, ["Every", "Lie", "group", "action", "Lie", "Group", "topology"]), (2, []), (3, ["a"] * 5), (4, None), (5, ["plain", "words"])], "eid int, tokens array<string>")
    got = {r.eid: r.tokens for r in preprocess.phrases_first(docs, phrases_).collect()}
    assert got[1] == ["lie_group_action", "lie_group", "every", "topology"] and got[2] == [] and got[3] == ["a_a", "a_a"] and got[5] == ["plain", "words"]


def test_discard_log(spark):
    df = spark.createDataFrame([(["the", "x", "the", "field"],), (None,)], "tokens array<string>")
    log = preprocess.discard_log(df)
    assert {(r.palabra, r.motivo, r.frecuencia) for r in log.collect()} == {("the", "stopword", 2), ("x", "sigla_corta", 1)}
    assert {(r.motivo, r.frecuencia) for r in preprocess.discard_summary(log).collect()} == {("stopword", 2), ("sigla_corta", 1)}


def test_dates(spark):
    df = spark.createDataFrame([("2020-01-31",), ("x",), (None,)], "cover_date string")
    assert [r.cover_date for r in preprocess.dated(df).collect()] == [date(2020, 1, 31)]


# --- bigrams ----------------------------------------------------------------------------------------------------


def test_greedy_merge(spark):
    starts = F.array(F.lit(0), F.lit(4))
    tokens = ["new", "york", "city", "york", "new", "york"]
    assert one(spark, phrases.merge(F.col("a"), starts), a=tokens) == ["new_york", "city", "york", "new_york"]
    assert one(spark, phrases.merge(F.col("a"), F.array().cast("array<int>")), a=["x", "y"]) == ["x", "y"]


def python_merge(tokens, known):
    out, k = [], 0
    while k < len(tokens):
        if k + 1 < len(tokens) and (tokens[k], tokens[k + 1]) in known:
            out.append(f"{tokens[k]}_{tokens[k + 1]}")
            k += 2
        else:
            out.append(tokens[k])
            k += 1
    return out


def test_learning_and_applying_against_a_plain_loop(spark):
    rng = random.Random(3)
    docs = [(k, [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]) for k in range(40)]
    df = spark.createDataFrame(docs, "eid long, tokens array<string>")
    words, pairs = {}, {}
    for _, t in docs:
        for w in t:
            words[w] = words.get(w, 0) + 1
        for p in zip(t, t[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    size = len(words) + len(pairs)
    want = {p: (n - 3) / words[p[0]] / words[p[1]] * size for p, n in pairs.items()}
    want = {p: s for p, s in want.items() if s > 0.1}
    learned = phrases.learn(df, min_count=3, threshold=0.1)
    got = {(r.a, r.b): r.score for r in learned.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)
    merged = {r.eid: r.tokens for r in phrases.apply(df, learned).collect()}
    assert merged == {k: python_merge(t, set(want)) for k, t in docs}


# --- vectors ----------------------------------------------------------------------------------------------------


def test_mean_vectors(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["zz"]), (3, []), (4, None), (5, ["a", "zz"])], "eid long, tokens array<string>")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<float>")
    got = {r.eid: (round(r.coverage_ratio, 4), [round(x, 4) for x in r.vector]) for r in vectors.mean_vectors(docs, words, 2).collect()}
    assert got == {1: (1.0, [0.6667, 1.0]), 2: (0.0, [0.0, 0.0]), 3: (0.0, [0.0, 0.0]), 4: (0.0, [0.0, 0.0]), 5: (0.5, [1.0, 0.0])}
    assert vectors.sample_coverage(docs, words).first().coverage_sample == pytest.approx(0.5)
    assert math.isnan(vectors.sample_coverage(docs.where("eid = 3"), words).first().coverage_sample)
    with pytest.raises(ValueError, match="dimensions"):
        vectors.check_dimension(words, 3)


def test_encoder_is_given_batches(spark):
    seen = vectors.encode(spark.createDataFrame([(1, "ab"), (2, None)], "eid long, text string"), lambda: lambda texts: [[float(len(t))] for t in texts])
    assert {r.eid: r.vector for r in seen.collect()} == {1: [2.0], 2: [0.0]}


def test_masked_mean(spark):
    df = spark.sql("select array(array(1d, 2d), array(3d, 4d)) as h, array(1, 0) as m, array(0, 0) as z")
    r = df.select(vectors.masked_mean(F.col("h"), F.col("m")).alias("a"), vectors.masked_mean(F.col("h"), F.col("z")).alias("b")).first()
    assert r.a == [1.0, 2.0] and r.b == [0.0, 0.0]


def test_grid(spark):
    with pytest.raises(ValueError, match="missing"):
        word2vec.read_grid(spark.createDataFrame([(1,)], "vector_size int"))
    cols = "vector_size int, window int, min_count int, sg int, epochs int"
    with pytest.raises(ValueError, match="no integer"):
        word2vec.read_grid(spark.createDataFrame([(8, None, 1, 1, 1)], cols))
    grid = word2vec.read_grid(spark.createDataFrame([(8, 2, 1, 1, 1), (8, 2, 99, 1, 1)], cols))
    docs = spark.createDataFrame([(k, ["a", "b"]) for k in range(6)], "eid long, tokens array<string>")
    out = word2vec.run_grid(docs, grid, sample=3).collect()
    assert [r.status for r in out] == ["trained_not_saved", "error"] and out[0].vocab_size == 2 and out[0].coverage_sample == 1.0


def test_histogram_and_history(spark):
    h = word2vec.histogram(spark.createDataFrame([(float(k),) for k in range(41)], "x double"), "x")
    got = {r.bin: r.n for r in h.collect()}
    assert sum(got.values()) == 41 and got[40] == 2 and min(got) == 1
    assert word2vec.histogram(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").first().n == 2
    e = word2vec.epoch_history(spark.createDataFrame([(1, 10.0), (2, 15.0)], "epoch int, loss_total double")).orderBy("epoch").collect()
    assert e[0].loss_delta is None and (e[1].loss_delta, e[1].loss_delta_pct) == (5.0, 50.0)


# --- novelty ----------------------------------------------------------------------------------------------------


def brute_index(rows, years):
    window, near = int(years * 365.25), years * 365.25
    rows = sorted((d.toordinal(), k, v) for k, d, v in rows if d is not None and v is not None)
    lo, hi = rows[0][0], rows[-1][0]

    def unit(v):
        n = max(math.sqrt(sum(x * x for x in v)), 1e-12)
        return [x / n for x in v]

    us = [unit(v) for _, _, v in rows]
    out = {}
    for t, (d, k, _) in enumerate(rows):
        if not lo + near <= d <= hi - near:
            continue
        past = [i for i in range(t) if rows[i][0] >= d - window]
        future = [i for i in range(t + 1, len(rows)) if rows[i][0] <= d + window]
        s = [max(sum((sum(a * b for a, b in zip(us[t], us[i])) + 1) / 2 for i in p), 1e-9) if p else 1e-9 for p in (past, future)]
        out[k] = (math.log(s[1] / s[0]), len(past), len(future))
    return out


def test_index_against_brute_force(spark):
    rng = random.Random(11)
    start = date(2000, 1, 1)
    rows = [(f"e{k:03d}", start + timedelta(days=rng.choice([0, 365, 366, 400, 731, 732, 1100, 1200, rng.randrange(1300)])), [rng.uniform(-1, 1) for _ in range(3)]) for k in range(90)]
    rows += [("z0", start + timedelta(days=500), [0.0, 0.0, 0.0]), ("n1", None, [1.0, 0.0, 0.0]), ("n2", start, None)]
    df = spark.createDataFrame(rows, "eid string, cover_date date, vector array<double>")
    got = {r.eid: (r.ki_score, r.past_pool_size, r.future_pool_size) for r in novelty.index(df, 1).collect()}
    want = brute_index(rows, 1)
    assert got.keys() == want.keys() and "z0" in got
    for k in want:
        assert got[k][1:] == want[k][1:] and math.isclose(got[k][0], want[k][0], abs_tol=1e-9)


def test_window_edges(spark):
    """Five years: the frame is 1826 days wide, eligibility starts 1827 days from the ends."""
    start = date(2000, 1, 1)
    days = [0, 1826, 1827, 1827 + 1826, 1827 + 1827]
    df = spark.createDataFrame([(f"e{d}", str(start + timedelta(days=d)), [1.0, d + 1.0]) for d in days], "eid string, cover_date string, vector array<double>")
    got = {r.eid: (r.past_pool_size, r.future_pool_size) for r in novelty.index(df, 5).collect()}
    assert got == {"e1827": (1, 1)}
    assert novelty.index(df.where("eid <> 'e3654'"), 5).count() == 0


def test_metadata_keeps_scored_articles(spark):
    meta = spark.createDataFrame([("a", "t", 3), ("b", "u", 4)], "eid string, title string, other int")
    out = novelty.with_metadata(meta, spark.createDataFrame([("a", 0.5, 1, 2)], "eid string, ki_score double, past_pool_size long, future_pool_size long"))
    assert out.columns == ["eid", "title", "ki_score", "past_pool_size", "future_pool_size"] and out.count() == 1


# --- records ----------------------------------------------------------------------------------------------------


def test_record_shapes(spark):
    good = """{"eid":"1","dc:description":"d","citedby-count":"7","affiliations":[],"authors":[
      {"@auid":"11","preferred-name":{"ce:indexed-name":"A."},"affiliation":{"@id":"5","affilname":" Uni "}},
      {"preferred-name":{},"affiliation":{"@id":"6"}},
      {"@auid":"12","preferred-name":{"ce:indexed-name":"B."},"affiliation":{"@id":"7","affiliation-name":"Uni"}},
      {"@auid":"","affiliation":[{"@id":"8"}]}],
      "keywords":{"$":"k"},"subject-areas":{"subject-area":[{"@code":"2600","$":"a"},{"@code":"2602","$":"b"},{"@code":"2615","$":"c"},{"@code":"x"}]},
      "item":{"bibrecord":{"head":{"citation-info":{"citation-language":[{"@xml:lang":"eng"}]}}}}}"""
    raw = spark.createDataFrame([(str(k), "t") for k in range(1, 6)], "eid string, title string")
    recs = spark.createDataFrame([("1", good), ("2", '{"eid":"2","error":"x"}'), ("3", "no json"), ("4", '{"eid":"4"}')], "eid string, record string")
    got = {r.eid: r for r in enrich.merge(raw, recs).collect()}
    assert set(got) == {"1", "4"}
    a = got["1"]
    assert (a.authors_full, a.authors_ids, a.num_authors) == ("A.; B.", "11; 12", 2)
    assert (a.affiliations_full, a.affiliations_ids, a.num_affiliations) == ("Uni; (sin nombre); Uni", "5; 6; 7", 3)
    assert (a.subject_areas, a.num_subdisciplinas, a.idioma, a.keywords, a.abstract, a.citedby_count) == ("2602-b", 1, "eng", "k", "d", "7")
    b = got["4"]
    assert (b.abstract, b.keywords, b.num_authors, b.affiliations_full, b.idioma) == (None, "", 0, "", "")
    assert enrich.merge(raw, recs, raw.where("eid = '1'")).count() == 1


# --- state and reports ------------------------------------------------------------------------------------------


def test_new_articles_keep_repeats_within_a_batch(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,)], "eid string")
    known = spark.createDataFrame([("a",)], "eid string")
    assert manifests.new_articles(batch, known).count() == 2
    assert manifests.new_articles(batch, known, distinct=True).count() == 1


def test_cursor_rules(spark):
    pages = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "a"), (6, "c")]
    df = spark.createDataFrame(pages, "page int, eid string")
    assert sorted((r.page, r.eid) for r in manifests.dedup_pages(df).collect()) == [(1, "a"), (1, "a"), (2, "b"), (6, "c")]
    assert manifests.stop_page(df).first().stop_page == 5


def test_years_and_lines(spark):
    lines = spark.createDataFrame([(" 1826 ",), ("x1827",), ("",), (None,), ("1828",), ("1828",)], "line string")
    assert manifests.stripped_lines(lines).count() == 3
    left = {r.year for r in manifests.pending_years(spark, manifests.years_done(lines), 1826, 1829).collect()}
    assert left == {1827, 1829}


@pytest.mark.parametrize(("done", "share", "weeks"), [(1_716_611, 47.15, 13), (1_866_595, 51.27, 12), (2_016_590, 55.39, 11)])
def test_published_reports(spark, done, share, weeks):
    r = spark.createDataFrame([(done,)], "n long").select(*reports.progress(F.col("n"))).first()
    assert (r.porcentaje_total, r.estimacion_semanas_restantes) == (share, weeks)


def test_quota_reset(spark):
    r = spark.sql("select timestamp '2025-11-11 21:30:00' as t").select(*reports.quota_reset(F.col("t"))).first()
    assert (r.horas_para_nueva_cuota, r.minutos_para_nueva_cuota) == (122, 30)


def test_describe(spark):
    r = reports.describe(spark.createDataFrame([(float(k),) for k in (1, 2, 3, 10)], "x double"), "x").first()
    assert (r.n, r.mean, r.min, r.q25, r.q50, r.q75, r.max) == (4, 4.0, 1.0, 1.75, 2.5, 4.75, 10.0)


# --- files and settings -----------------------------------------------------------------------------------------


def test_csv_round_trip_and_header(spark, tmp_path):
    rows = [("1", 'a "quoted"\nline', "NA"), ("2", "x\\y", "")]
    df = spark.createDataFrame(rows, "eid string, title string, abstract string")
    files.write_csv(df, str(tmp_path / "c"))
    got = sorted((r.eid, r.title, r.abstract or "") for r in files.read_csv(spark, str(tmp_path / "c")).collect())
    assert got == rows
    assert files.header([["z", "eid", "idioma"], ["abstract", "b", "text"]], ("text",)) == ["eid", "abstract", "b", "z", "text"]


def test_records_from_files(spark, tmp_path):
    (tmp_path / "metadata_2-s2.0-1.json").write_text('{"eid": "1",\n"error": "x"}')
    (tmp_path / "other.json").write_text("{}")
    assert [(r.eid, len(r.record)) for r in files.read_records(spark, str(tmp_path)).collect()] == [("2-s2.0-1", 26)]


def test_settings(monkeypatch):
    assert HarvestConfig().offset_cap == 4975
    assert Layout("/d/").path("raw", "x.csv") == "/d/raw/x.csv"
    with pytest.raises(ValueError):
        Layout("/d").path("nowhere")
    monkeypatch.delenv("API_KEY", raising=False)
    with pytest.raises(RuntimeError):
        Credentials.from_env()
    monkeypatch.setenv("API_KEY", "k")
    assert "k'" not in repr(Credentials.from_env()) and Credentials.from_env().headers()["Accept"] == "application/json"


def test_command_line():
    assert cli.arguments(["filter", "--", "todo"]).todo
    assert cli.arguments(["filter", "--decada", "1990_1999"]).decada == "1990_1999"
    for bad in (["filter"], ["filter", "--todo", "--decada", "1990_1999"], ["filter", "--decada", "1990"]):
        with pytest.raises(SystemExit):
            cli.arguments(bad)


def load_model():
    return lambda texts: [("en", 0.9) if "the" in x.split() else ("xx", 0.5) for x in texts]


def test_a_model_as_detector(spark):
    rows = [("the title", "the text of some words"), ("THE title", "short one"), ("no", "the text of some words"), (None, None), ("the", "no such word is here")]
    df = spark.createDataFrame(rows, "title string, abstract string")
    got = [(r.lang_abstract, round(r.conf_abstract, 2), r.lang_title) for r in langid.detect(df, langid.model_detector(load_model)).collect()]
    assert got == [("en", 0.9, "en"), ("", 0.0, ""), ("en", 0.9, "xx"), ("", 0.0, ""), ("xx", 0.5, "")]
    ok, other = langid.split(langid.detect(df, langid.model_detector(load_model)))
    assert ok.count() == 1 and other.count() == 4


def test_the_detector_is_not_copied(spark):
    """Conditions on the languages do not bring copies of the detector into the plan."""
    df = spark.createDataFrame([("a", "b")], "title string, abstract string")
    plan = langid.split(langid.detect(df))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2


def test_another_lemmatizer(spark):
    assert one(spark, preprocess.kept_lemmas(F.col("a"), None, lambda w: F.regexp_replace(F.lower(w), "s$", "")), a=["Groups", "act"]) == ["group", "act"]
