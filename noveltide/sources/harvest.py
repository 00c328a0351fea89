"""The harvest connector: paging, quota and retry rules behind an injectable transport and clock.

It runs on the driver (the service allows a few requests a second); what it fetches is appended as tables.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from noveltide.config import HarvestConfig
from noveltide.sources.state import Ledger


@dataclass
class Response:
    status: int
    body: dict[str, Any] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)


class Transport(Protocol):
    def __call__(self, params: dict[str, Any]) -> Response: ...


class HarvestError(RuntimeError):
    pass


@dataclass
class Client:
    """Requests with adaptive pacing.

    Too many requests (429): wait 60 s times the attempt (600 s at most), and before giving up until the quota resets.
    Other failures double the wait, up to the maximum.  Fifty successes in a row shorten the pause between requests,
    three failures double it; after many requests longer pauses are made.
    """

    transport: Transport
    cfg: HarvestConfig = field(default_factory=HarvestConfig)
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.time
    metrics: dict[str, int] = field(default_factory=lambda: {"requests": 0, "errors": 0, "low_quota": 0})
    ledger: Ledger | None = None

    def __post_init__(self) -> None:
        self.pause = self.cfg.sleep_start
        self.good = self.bad = self.since_short = self.since_long = 0

    def until_reset(self, r: Response) -> float:
        """Seconds to the quota's reset and two more; 60 if the header is missing or bad."""
        try:
            return max(0.0, float(r.headers["X-RateLimit-Reset"]) - self.now()) + 2
        except (KeyError, ValueError):
            return 60.0

    def watch_quota(self, r: Response, low: int = 5000) -> None:
        if self.ledger is not None:
            self.metrics["low_quota"] += self.ledger.saw(r.headers, self.now())
            return
        left = r.headers.get("X-RateLimit-Remaining", "")
        if left.isdigit() and int(left) < low:
            self.metrics["low_quota"] += 1

    def get(self, params: dict[str, Any]) -> dict[str, Any]:
        wait = self.pause
        for attempt in range(self.cfg.attempts):
            try:
                r = self.transport(params)
            except OSError:
                r = Response(0)
            self.watch_quota(r)
            if r.status == 200:
                self._succeeded()
                return r.body
            if r.status == 429:
                last = attempt == self.cfg.attempts - 1
                self.sleep(self.until_reset(r) if last else min(60 * (attempt + 1), 600))
                continue
            self._failed()
            if r.status == 404:
                break
            self.sleep(wait)
            wait = min(wait * 2, self.cfg.sleep_most)
        raise HarvestError(f"no answer after {self.cfg.attempts} attempts")

    def _succeeded(self) -> None:
        self.metrics["requests"] += 1
        self.bad = max(self.bad - 1, 0)
        self.good += 1
        self.since_short += 1
        self.since_long += 1
        if self.good >= self.cfg.speed_up_after and self.pause > self.cfg.sleep_least:
            self.pause, self.good = max(self.cfg.sleep_least, self.pause - 0.1), 0
        if self.since_long >= self.cfg.long_pause[0]:
            self.sleep(self.cfg.long_pause[1])
            self.since_long = self.since_short = 0
        elif self.since_short >= self.cfg.short_pause[0]:
            self.sleep(self.cfg.short_pause[1])
            self.since_short = 0
        self.sleep(self.pause)

    def _failed(self) -> None:
        self.metrics["errors"] += 1
        self.bad += 1
        self.good = 0
        if self.bad >= self.cfg.slow_down_after:
            self.pause, self.bad = min(self.cfg.sleep_most, self.pause * 2), 0


def strategy(total: int, cfg: HarvestConfig | None = None) -> str:
    return "cursor" if total > (cfg or HarvestConfig()).offset_cap else "start"


def page_starts(total: int, cfg: HarvestConfig | None = None) -> list[int]:
    cfg = cfg or HarvestConfig()
    return [k * cfg.page_size for k in range(math.ceil(min(total, cfg.offset_cap) / cfg.page_size))]


class CursorStore:
    """Where the paging of a year stands, and the articles of its pages so far; both survive a restart."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def load(self, year: int) -> str:
        f = self.folder / f"cursor_{year}.txt"
        return f.read_text().strip() or "*" if f.exists() else "*"

    def save(self, year: int, cursor: str) -> None:
        (self.folder / f"cursor_{year}.txt").write_text(cursor)

    def staged(self, year: int) -> list[dict]:
        f = self.folder / f"staged_{year}.json"
        try:
            return json.loads(f.read_text()) if f.exists() else []
        except ValueError:
            return []

    def stage(self, year: int, entries: list[dict]) -> None:
        (self.folder / f"staged_{year}.json").write_text(json.dumps(entries, ensure_ascii=False))

    def clear(self, year: int) -> None:
        for name in (f"cursor_{year}.txt", f"staged_{year}.json"):
            (self.folder / name).unlink(missing_ok=True)


def by_offset(client: Client, query: str, total: int) -> Iterator[list[dict]]:
    """Pages of entries; repeats stay."""
    for start in page_starts(total, client.cfg):
        body = client.get({"query": query, "start": start, "count": client.cfg.page_size})
        yield body.get("search-results", {}).get("entry", [])


def by_cursor(client: Client, query: str, year: int, store: CursorStore) -> Iterator[list[dict]]:
    """Pages of entries whose id no earlier page had (repeats within a page stay); resumes where it stopped."""
    staged, cursor, idle = store.staged(year), store.load(year), 0
    seen = {e.get("eid") for e in staged}
    if staged:
        yield list(staged)
    while idle < client.cfg.empty_pages:
        results = client.get({"query": query, "cursor": cursor, "count": client.cfg.page_size}).get("search-results", {})
        fresh = [e for e in results.get("entry", []) if e.get("eid") not in seen]
        seen |= {e.get("eid") for e in fresh}
        idle = 0 if fresh else idle + 1
        cursor = (results.get("cursor") or {}).get("@next") or ""
        staged += fresh
        store.stage(year, staged)
        if fresh:
            yield fresh
        if not cursor:
            return
        store.save(year, cursor)


def harvest_year(client: Client, year: int, store: CursorStore, append: Callable[[int, list[dict]], int], done: Callable[[int], int | None]) -> int:
    """Counts, pages and appends one year; marks it done.  Returns the number of appended articles.

    ``append`` may hold articles back; ``done`` writes them and returns their number.
    """
    query = client.cfg.query.format(year=year)
    body = client.get({"query": query, "start": 0, "count": 1})
    total = int(body.get("search-results", {}).get("opensearch:totalResults") or 0)
    added = 0
    if total:
        pages = by_cursor(client, query, year, store) if strategy(total, client.cfg) == "cursor" else by_offset(client, query, total)
        for page in pages:  # what has come is kept, whatever happens later
            added += append(year, page)
    added += done(year) or 0
    store.clear(year)
    return added


def harvest(client: Client, years: list[int], finished: set[int], store: CursorStore, append, done, report: Callable[[dict[str, Any]], None] | None = None) -> dict[int, int]:
    """All years that are not finished, in order, after a warm-up pause.

    After the last year of each decade ``report`` is given the decade, the articles so far, the seconds taken, and the
    seconds that the decades left will take at the mean pace.
    """
    todo = [y for y in years if y not in finished]
    began, total, decades, out = client.now(), max(years, default=0) // 10 - min(years, default=0) // 10 + 1, 0, {}
    if todo:
        client.sleep(client.cfg.warm_up)
    for y in todo:
        out[y] = harvest_year(client, y, store, append, done)
        if y % 10 == 9 and report is not None:
            decades += 1
            took = client.now() - began
            report({"decade": f"{y - 9}_{y}", "articles": sum(out.values()), "seconds": took, "left": total - decades, "eta_seconds": took / decades * (total - decades)})
    return out
