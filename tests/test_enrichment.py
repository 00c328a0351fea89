"""The enrichment run and the stages of the command line, with a transport that answers from memory."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from noveltide import cli
from noveltide.config import EnrichConfig, Layout
from noveltide.operators import enrich, word2vec
from noveltide.sources import files
from noveltide.sources.enrichment import Enrichment, NoRecord, fetch
from noveltide.sources.harvest import Client, HarvestConfig, Response
from noveltide.sources.state import Ledger, Lines, rotating_log

NOW = 1_762_853_657.0  # 2025-11-11


def answer(eid):
    words = "the of and to in is that for it was on are as with be by this from at an".split()
    abstract = " ".join(f"{words[k % len(words)]} term{(int(eid[1:]) + k) % 7}" for k in range(40))
    author = {"@auid": f"a{eid}", "preferred-name": {"ce:indexed-name": f"Name {eid}"}, "affiliation": {"@id": "7", "affilname": "Place"}}
    return {
        "abstracts-retrieval-response": {
            "coredata": {"dc:description": abstract, "citedby-count": "3"},
            "authors": {"author": [author]},
            "affiliation": [{"@id": "7", "affilname": "Place"}],
            "subject-areas": {"subject-area": [{"@code": "2602", "$": "Algebra"}]},
            "item": {"bibrecord": {"head": {"citation-info": {"citation-language": {"@xml:lang": "eng"}, "author-keywords": {"author-keyword": [{"$": "key"}]}}}}},
        }
    }


class Service:
    """Answers by id; an id in ``odd`` gets what stands there."""

    def __init__(self, **odd):
        self.odd, self.asked = odd, []

    def __call__(self, params):
        self.asked.append(params["eid"])
        out = self.odd.get(params["eid"], Response(200, answer(params["eid"])))
        if isinstance(out, list):
            out = out.pop(0)
        if isinstance(out, BaseException):
            raise out
        return out


def raw(tmp_path, **names):
    (tmp_path / "raw").mkdir(exist_ok=True)
    for name, ids in names.items():
        files.append_rows(str(tmp_path / "raw" / f"{name}.csv"), ["eid", "title", "cover_date"], [{"eid": i, "title": f"the title of {i}", "cover_date": f"20{int(i[1:]) % 30:02d}-01-01"} for i in ids])


def test_fetch_waits_and_gives_up():
    slept = []
    s = Service(e1=[Response(200, {}, {"X-RateLimit-Remaining": "0", "X-RateLimit-Limit": "9", "X-RateLimit-Reset": "500"}), Response(429), Response(500), OSError("x"), Response(200, {"a": 1})], e2=Response(404), e3=Response(500), e4=Response(429, {}, {"X-RateLimit-Reset": "110"}))
    assert fetch(s, "e1", sleep=slept.append, now=lambda: 100.0).body == {"a": 1} and slept == [400, 300, 4, 8]
    with pytest.raises(NoRecord, match="404"):
        fetch(s, "e2")
    slept.clear()
    with pytest.raises(NoRecord):
        fetch(s, "e3", sleep=slept.append)
    assert slept == [1, 2, 4, 8, 16]
    slept.clear()
    with pytest.raises(NoRecord):
        fetch(s, "e4", sleep=slept.append, now=lambda: 100.0)
    assert slept == [60] * 5


def test_answers_become_records(spark):
    core = answer("e1")
    other = {"affiliation": {"@id": "1"}, "coredata": {"dc:description": "text"}}
    rows = [("e1", core), ("e2", {}), ("e3", {enrich.ANSWER_KEY: {"item": 3}}), ("e4", {enrich.ANSWER_KEY: other}), ("e5", {"eid": "e5", "dc:description": "kept", "keywords": "k"})]
    got = {r.eid: r for r in enrich.parse_record(spark.createDataFrame([(i, json.dumps(x)) for i, x in rows], "eid string, record string")).collect()}
    assert got["e1"].r["keywords"] == '[{"$":"key"}]' and got["e1"].r["citedby-count"] == "3" and got["e1"].error is None
    assert got["e1"].r["authors"][0]["preferred-name"]["ce:indexed-name"] == "Name e1" and got["e1"].r["item"].bibrecord.head["citation-info"]["citation-language"] == '{"@xml:lang":"eng"}'
    assert got["e2"].error and got["e3"].error and got["e4"].error is None and got["e4"].r.affiliations is None and got["e4"].r.eid == "e4"
    assert got["e5"].error is None and got["e5"].r["dc:description"] == "kept"


def test_a_run_and_its_restart(spark, tmp_path):
    raw(tmp_path, a=["e1", "e2", "e3", "e3", "e4", "e5"], b=["e6", "e7"], c=["e8"])
    at, state = Layout(str(tmp_path)), Lines(str(tmp_path / "state"))
    state.add("excluded", "e2")
    state.add("processed", "c.csv")
    state.add("progress", "old")
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata/metadata_e5.json").write_text(json.dumps(answer("e5")))
    service = Service(e4=Response(404), e7=Response(200, {}))
    cfg = EnrichConfig(merge_every=1, weekly_quota=3)
    run = Enrichment(spark, at, service, cfg, sleep=lambda s: None, now=lambda: NOW)
    r = run.run().first()
    # e1, e3 and e6 are fetched, then the quota is used up and file b stays open.
    assert service.asked == ["e1", "e3", "e4", "e6"]
    assert (r.semana, r.descargados_nuevos, r.existentes, r.errores, r.progreso_total) == ("2025_11_11", 3, 1, 1, 5)
    assert state.load("omitted") == {"e2"} and state.load("excluded") == {"e2", "e4"} and state.load("errors") == {"e4,404"}
    assert state.load("processed") == {"a.csv", "c.csv"} and state.load("progress") == {"old", "e1", "e3", "e5", "e6"}
    assert json.loads((tmp_path / "reports/weekly_2025_11_11.json").read_text())["errores"] == 1
    merged = files.read_csv(spark, at.path("enriched", "a")).collect()
    assert sorted(x.eid for x in merged) == ["e1", "e3", "e3", "e5"] and {x.affiliations_full for x in merged} == {"Place"}
    assert not list((tmp_path / "metadata").glob("*"))
    again = Enrichment(spark, at, service, cfg, sleep=lambda s: None, now=lambda: NOW)
    again.run()
    # The malformed answer counts as fetched, is logged, kept, and never merged.
    assert service.asked[4:] == ["e7"] and state.load("processed") == {"a.csv", "b.csv", "c.csv"}
    assert [x.split(",")[0] for x in state.load("malformed")] == ["e7"]
    assert [x.eid for x in files.read_csv(spark, at.path("enriched", "b")).collect()] == ["e6"] and (tmp_path / "metadata/metadata_e7.json").exists()


def test_an_interrupted_run_keeps_what_it_has(spark, tmp_path):
    raw(tmp_path, a=["e1", "e2"])
    run = Enrichment(spark, Layout(str(tmp_path)), Service(e2=KeyboardInterrupt()), sleep=lambda s: None, now=lambda: NOW)
    assert run.run().first().descargados_nuevos == 1
    assert [x.eid for x in files.read_csv(spark, str(tmp_path / "enriched/a")).collect()] == ["e1"]
    assert not Lines(str(tmp_path / "state")).load("processed")
    assert Enrichment(spark, Layout(str(tmp_path / "none")), Service(), now=lambda: NOW).run().first().descargados_nuevos == 0


def test_ledger_and_log(tmp_path):
    ledger = Ledger(str(tmp_path))
    assert ledger.count() == 0
    c = Client(lambda p: Response(200, {}, {"X-RateLimit-Remaining": "10", "X-RateLimit-Reset": "500"}), HarvestConfig(), sleep=lambda s: None, now=lambda: 100.0, ledger=ledger)
    c.get({})
    c.get({})
    assert Ledger(str(tmp_path)).count() == 2 and c.metrics["low_quota"] == 2 and len(Lines(str(tmp_path)).load("quota")) == 1
    assert [f.read_text() for f in tmp_path.glob("requests_before_reset_*")] == ["2"]
    log = rotating_log(str(tmp_path / "logs/x.log"), size=200, copies=2)
    for k in range(30):
        log.info("line %d of the log", k)
    assert sorted(f.name for f in (tmp_path / "logs").iterdir()) == ["x.log", "x.log.1", "x.log.2"]


def search_service(params):
    entries = [{"eid": f"e{k}", "dc:title": "the title of ﬁ", "prism:coverDate": "1999-01-01"} for k in range(3)] if "1999" in params["query"] else []
    return Response(200, {"search-results": {"entry": entries, "opensearch:totalResults": str(len(entries))}})


def embed(tokens):
    return [[float(len(t)), 1.0] for t in tokens]


def load_embedder():
    return embed


def first_letters(text):
    return list(text)


def test_all_stages(spark, tmp_path):
    def stage(name, *more, transport=None):
        cli.run(spark, cli.arguments([name, "--todo", "--root", str(tmp_path), *more]), transport, lambda s: None)

    stage("harvest", transport=search_service)
    rows = files.read_csv(spark, str(tmp_path / "raw/articles_1990_1999.csv")).collect()
    assert sorted(r.eid for r in rows) == ["e0", "e1", "e2"] and {r.title for r in rows} == {"the title of fi"}
    state = Lines(str(tmp_path / "state"))
    assert len(state.load("years")) == 199 and any(x.startswith("1990_1999: 3 articles") for x in state.load("decades"))
    shutil.rmtree(tmp_path / "raw/articles_1990_1999.csv")
    raw(tmp_path, articles_2000_2029=[f"e{k}" for k in range(60)])
    stage("enrich", "--test", transport=Service())
    assert len(state.load("progress")) == 2
    stage("enrich", transport=Service())
    stage("filter")
    assert spark.read.parquet(str(tmp_path / "filtered/todo")).count() == 60
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens/whitelist.csv").write_text("palabra\ntitle\nterm1 is\n")
    stage("preprocess")
    tokens = {t for r in spark.read.parquet(str(tmp_path / "tokens/todo")).collect() for t in r.tokens}
    assert "term1_is" in tokens and "title" in tokens and "the" not in tokens
    (tmp_path / "models").mkdir()
    (tmp_path / "models/grid.csv").write_text("vector_size,window,min_count,sg,epochs\n4,2,1,1,1\n3,2,100000,1,1\n")
    stage("grid", "--sample", "20")
    stage("grid", "--sample", "20", "--overwrite")
    grid = word2vec.results(spark, str(tmp_path / "models/grid_todo")).collect()
    assert sorted((r.vector_size, r.status) for r in grid) == [(3, "error"), (4, "ok")] and all(r.coverage_sample == 1.0 for r in grid if r.status == "ok")
    stage("train")
    assert not cli.run_train(spark, Layout(str(tmp_path)), "2000_2009")
    log = json.loads(spark.read.text(str(tmp_path / "models/log_todo")).first().value)
    assert log["vector_size"] == 200 and log["vocab_size"] > 0 and spark.read.csv(str(tmp_path / "models/norms_todo"), header=True).count() > 0
    stage("vectors")
    out = spark.read.parquet(str(tmp_path / "vectors/todo"))
    assert out.count() == 60 and out.where(F.size("vector") != 200).count() == 0
    stage("novelty")
    scored = spark.read.parquet(str(tmp_path / "novelty/word2vec_todo"))
    assert 0 < scored.count() < 60 and files.read_csv(spark, str(tmp_path / "novelty/word2vec_todo_csv")).count() == scored.count()
    stage("report")
    stage("encode", "--encoder", "tests.test_enrichment:load_embedder", "--tokenizer", "tests.test_enrichment:first_letters")
    assert {tuple(r.vector) for r in spark.read.parquet(str(tmp_path / "vectors/encoder_todo")).select("vector").collect()} <= {(float(k), 1.0) for k in range(1, 513)}
    stage("novelty", "--model", "encoder")
    assert spark.read.parquet(str(tmp_path / "novelty/encoder_todo")).count() == scored.count()
    assert "novelty todo" in (tmp_path / "reports/noveltide.log").read_text()
