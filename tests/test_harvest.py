from __future__ import annotations

import json

import pytest

from noveltide.config import HarvestConfig
from noveltide.sources import files, search_source
from noveltide.sources.decades import DecadeSink
from noveltide.sources.harvest import Client, CursorStore, HarvestError, Response, by_cursor, by_offset, harvest, page_starts, strategy
from noveltide.streaming import incremental


def page(ids, following=None, total=None):
    return Response(200, {"search-results": {"entry": [{"eid": i} for i in ids], "cursor": {"@next": following}, "opensearch:totalResults": str(total)}})


class Script:
    """Answers in order; keeps the requests and the sleeps."""

    def __init__(self, *answers):
        self.answers, self.asked, self.slept = list(answers), [], []

    def __call__(self, params):
        self.asked.append(params)
        out = self.answers.pop(0)
        if isinstance(out, BaseException):
            raise out
        return out


def client(script, **kw):
    return Client(script, HarvestConfig(**kw), sleep=script.slept.append, now=lambda: 100.0)


def test_paging_plan():
    assert strategy(4975) == "start" and strategy(4976) == "cursor"
    assert page_starts(51) == [0, 25, 50] and len(page_starts(10**6)) == 199 and page_starts(0) == []


def test_retries_and_waits():
    s = Script(Response(429), Response(429), Response(500), OSError("reset"), page(["a"]))
    assert client(s).get({})["search-results"]["entry"] == [{"eid": "a"}]
    assert s.slept[:4] == [60, 120, 1.0, 2.0]
    s = Script(*[Response(429, headers={"X-RateLimit-Reset": "130"})] * 5)
    with pytest.raises(HarvestError):
        client(s).get({})
    assert s.slept == [60, 120, 180, 240, 32.0]
    s = Script(Response(404))
    with pytest.raises(HarvestError):
        client(s).get({})


def test_pacing():
    s = Script(*[page(["a"])] * 101)
    c = client(s, short_pause=(100, 300.0))
    for _ in range(101):
        c.get({})
    assert c.pause == pytest.approx(0.8) and 300.0 in s.slept
    s = Script(*[Response(500)] * 3, page([]))
    c = client(s)
    c.get({})
    assert c.pause == 2.0


def test_quota_is_watched():
    s = Script(Response(200, {}, {"X-RateLimit-Remaining": "10"}))
    c = client(s)
    c.get({})
    assert c.metrics["low_quota"] == 1


def test_cursor_keeps_repeats_within_a_page_and_stops(tmp_path):
    s = Script(page(["a", "a"], "c1"), page(["a", "b"], "c2"), page(["a"], "c3"), page(["b"], "c4"), page(["a"], "c5"), page(["z"], "c6"))
    got = list(by_cursor(client(s), "q", 2000, CursorStore(str(tmp_path))))
    assert [[e["eid"] for e in p] for p in got] == [["a", "a"], ["b"]]
    assert len(s.asked) == 5


def test_cursor_resumes(tmp_path):
    store = CursorStore(str(tmp_path))
    assert store.load(2000) == "*"
    s = Script(page(["a"], "c1"), KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        list(by_cursor(client(s), "q", 2000, store))
    s = Script(page(["a", "b"], None))
    got = list(by_cursor(client(s), "q", 2000, store))
    assert s.asked[0]["cursor"] == "c1" and [[e["eid"] for e in p] for p in got] == [["a"], ["b"]]
    (tmp_path / "staged_2000.json").write_text("broken")
    assert store.staged(2000) == []


def test_years(tmp_path):
    s = Script(page([], total=0), page([], total=30), page(["a", "b"]), page(["b"]))
    added, done = {}, []
    out = harvest(client(s), [1, 2, 3], {3}, CursorStore(str(tmp_path)), lambda y, e: added.setdefault(y, []).extend(x["eid"] for x in e) or len(e), done.append)
    assert out == {1: 0, 2: 3} and added == {2: ["a", "b", "b"]} and done == [1, 2] and s.slept[0] == 300.0
    assert harvest(client(Script()), [3], {3}, CursorStore(str(tmp_path)), None, None) == {}


def test_offset_pages():
    s = Script(page(["a"]), page(["a"]))
    assert [[e["eid"] for e in p] for p in by_offset(client(s), "q", 26)] == [["a"], ["a"]]


def fixed_transport():
    return lambda params: page([f"e{params['start'] + k}" for k in range(params["count"])])


def test_data_source(spark):
    search_source.register(spark)
    df = spark.read.format("search_pages").option("transport", "tests.test_harvest:fixed_transport").option("query", "q").option("total", "60").option("pages_per_partition", "2").load()
    got = df.collect()
    assert df.rdd.getNumPartitions() == 2 and len(got) == 75 and {r.page for r in got} == {0, 1, 2}
    assert json.loads(got[0].entry)["eid"] == "e0"


def test_incremental(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    schema = "eid string, cover_date string"
    (tmp_path / "in/1.json").write_text('{"eid":"a","cover_date":"1999-01-01"}\n{"eid":"a","cover_date":"1999-01-01"}\n')
    incremental.run(spark, source, schema, target, state).awaitTermination()
    (tmp_path / "in/2.json").write_text('{"eid":"a","cover_date":"1999-01-01"}\n{"eid":"b","cover_date":"2003-01-01"}\n')
    incremental.run(spark, source, schema, target, state).awaitTermination()
    assert sorted((r.eid, r.decade) for r in spark.read.parquet(target).collect()) == [("a", 1990), ("b", 2000)]


def cursor_transport():
    """Pages of two; the same for the same cursor, whoever asks."""
    pages = {"*": (["a", "a"], "c1"), "c1": (["a", "b"], "c2"), "c2": (["c", "d"], "c3"), "c3": (["d", "e"], "c4"), "c4": (["f", "g"], None)}

    def answer(params):
        ASKED.append(params["cursor"])
        return page(*pages[params["cursor"]])

    return answer


ASKED: list[str] = []


def endless_transport():
    return lambda params: page(["a", "b"], f"c{int(params['cursor'].removeprefix('c') or 0) + 1 if params['cursor'] != '*' else 1}")


@pytest.mark.parametrize("pages", ["1", "2", "40"])
def test_a_stream_follows_the_cursor(spark, tmp_path, pages):
    options = {"transport": "tests.test_harvest:cursor_transport", "query": "q", "pages_per_batch": pages}
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    assert incremental.harvest_stream(spark, options, target, state) == 8
    rows = spark.read.parquet(target).collect()
    assert sorted((r.page, r.eid) for r in rows) == [(0, "a"), (0, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e"), (4, "f"), (4, "g")]
    # Started again, it knows that it is at the end.
    assert incremental.harvest_stream(spark, options, target, state) == 8


def test_a_stopped_stream_goes_on_at_its_page(spark, tmp_path):
    search_source.register(spark)
    options = {"transport": "tests.test_harvest:cursor_transport", "query": "q", "pages_per_batch": "2"}
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    taken = []

    def stop_in_second(batch, number):
        taken.append([(r.page, json.loads(r.entry)["eid"]) for r in batch.collect()])
        if number == 1:
            raise RuntimeError("killed")

    query = spark.readStream.format("search_pages").options(**options).load().writeStream.foreachBatch(stop_in_second).option("checkpointLocation", state).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(60)
    assert [[p for p, _ in b] for b in taken] == [[0, 0, 1, 1], [2, 2, 3, 3]]
    # The batch that was not committed comes again as it was, then the rest; the first pages do not.
    incremental.harvest_stream(spark, options, target, state)
    assert sorted((r.page, r.eid) for r in spark.read.parquet(target).collect()) == [(2, "c"), (2, "d"), (3, "e"), (4, "f"), (4, "g")]


def test_a_stream_ends_after_empty_pages(spark, tmp_path):
    options = {"transport": "tests.test_harvest:endless_transport", "query": "q", "pages_per_batch": "1"}
    assert incremental.harvest_stream(spark, options, str(tmp_path / "out"), str(tmp_path / "state")) == 2


def entries(*ids):
    return [{"eid": i, "dc:title": f"title {i}", "prism:coverDate": "1999-01-01"} for i in ids]


def test_decades_are_written_in_batches(spark, tmp_path):
    sink = DecadeSink(spark, str(tmp_path / "raw"), str(tmp_path / "ids"), batch=4)
    assert [sink.add(1999, entries("a", "a")), sink.add(1999, entries("b")), sink.add(2001, entries("z"))] == [0, 0, 0] and sink.jobs == 0
    assert sink.add(1999, entries("c", "d")) == 5 and sink.jobs == 1  # repeats within a batch stay
    assert sink.add(1995, entries("a", "e")) == 0 and sink.flush() == 2 and sink.jobs == 3
    assert sorted(r.eid for r in files.read_csv(spark, sink.target(1990)).collect()) == ["a", "a", "b", "c", "d", "e"]
    assert [r.title for r in files.read_csv(spark, sink.target(2000)).collect()] == ["title z"] and sink.flush() == 0


def test_articles_without_ids_are_found_again(spark, tmp_path, monkeypatch):
    folders = str(tmp_path / "raw"), str(tmp_path / "ids")
    sink = DecadeSink(spark, *folders)
    sink.add(1999, entries("a"))
    sink.flush()
    write = files.write_csv

    def killed(df, path, *mode):
        write(df, path, *mode)
        raise KeyboardInterrupt

    monkeypatch.setattr(files, "write_csv", killed)  # after the articles, before their ids
    sink.add(1999, entries("b"))
    with pytest.raises(KeyboardInterrupt):
        sink.flush()
    monkeypatch.undo()
    again = DecadeSink(spark, *folders)
    again.add(1999, entries("a", "b", "c"))
    assert again.flush() == 1
    assert sorted(r.eid for r in files.read_csv(spark, again.target(1990)).collect()) == ["a", "b", "c"]
