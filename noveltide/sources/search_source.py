"""A Spark data source over the search service: ``spark.read.format("search_pages")`` and ``spark.readStream``.

Options: ``transport`` (``module:function`` that returns the client's transport) and ``query``.

A batch read has ``total`` as well; offset pages are dealt to partitions, each of which fetches its pages with a client
of its own.  A stream follows the cursor: its offset is the cursor and the number of pages so far, which Spark keeps in the
query's ``checkpointLocation``.  A run that was stopped goes on with the page after the last one it took in; pages of a batch that was
not committed are fetched again by the cursors of their offsets.  ``pages_per_batch`` pages make a batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from noveltide.sources.harvest import Client, page_starts


class SearchPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return "page int, entry string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return CursorReader(dict(self.options))


def client_of(options: dict[str, str]) -> Client:
    module, _, function = options["transport"].partition(":")
    pause = (lambda s: None) if options.get("pace", "no") == "no" else time.sleep
    return Client(getattr(import_module(module), function)(), sleep=pause)


class PageRange(InputPartition):
    def __init__(self, starts: list[int]):
        self.starts = starts


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        starts = page_starts(int(self.options["total"]))
        size = int(self.options.get("pages_per_partition", "20"))
        return [PageRange(starts[k : k + size]) for k in range(0, len(starts), size)] or [PageRange([])]

    def read(self, partition: PageRange) -> Iterator[tuple[int, str]]:
        client = client_of(self.options)
        for start in partition.starts:
            body = client.get({"query": self.options["query"], "start": start, "count": client.cfg.page_size})
            for e in body.get("search-results", {}).get("entry", []):
                yield start // client.cfg.page_size, json.dumps(e, ensure_ascii=False)


class CursorReader(SimpleDataSourceStreamReader):
    """Offsets: ``{"cursor", "page"}``; an empty cursor is the end of the search."""

    def __init__(self, options: dict[str, str]):
        self.options, self.client = options, client_of(options)

    def initialOffset(self) -> dict:
        return {"cursor": "*", "page": 0}

    def page(self, at: dict) -> tuple[list[tuple[int, str]], dict]:
        found = self.client.get({"query": self.options["query"], "cursor": at["cursor"], "count": self.client.cfg.page_size}).get("search-results", {})
        rows = [(at["page"], json.dumps(e, ensure_ascii=False)) for e in found.get("entry", [])]
        return rows, {"cursor": (found.get("cursor") or {}).get("@next") or "", "page": at["page"] + 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        for _ in range(int(self.options.get("pages_per_batch", "40"))):
            if not at["cursor"]:
                break
            more, at = self.page(at)
            rows += more
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at["page"] < end["page"]:
            rows, at = self.page(at)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


def register(spark) -> None:
    spark.dataSource.register(SearchPages)
