"""What a run has done, as append-only line files and counters on the driver; a restart reads them again."""

from __future__ import annotations

import logging
from datetime import datetime, timezone
from logging.handlers import RotatingFileHandler
from pathlib import Path


class Lines:
    """Named sets of lines, each in a file that is only appended to (and flushed with each line)."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def path(self, name: str) -> Path:
        return self.folder / f"{name}.txt"

    def load(self, name: str) -> set[str]:
        """The distinct non-empty lines, without white space around them."""
        f = self.path(name)
        return {x.strip() for x in f.read_text(encoding="utf-8").splitlines() if x.strip()} if f.exists() else set()

    def add(self, name: str, *lines: str) -> None:
        if lines:
            with self.path(name).open("a", encoding="utf-8") as f:
                f.writelines(f"{x}\n" for x in lines)


class Ledger:
    """The number of requests, kept over restarts; a log of low quotas; a copy of the number before the quota resets."""

    def __init__(self, folder: str, low: int = 5000, near: float = 600.0):
        self.lines, self.low, self.near = Lines(folder), low, near

    def count(self) -> int:
        f = self.lines.path("requests")
        text = f.read_text(encoding="utf-8").strip() if f.exists() else ""
        return int(text or 0)

    def set(self, value: int) -> None:
        self.lines.path("requests").write_text(str(value), encoding="utf-8")

    def saw(self, headers: dict[str, str], now: float) -> bool:
        """Counts a request and looks at its quota headers; whether the quota is low."""
        self.set(self.count() + 1)
        left, reset = headers.get("X-RateLimit-Remaining", ""), headers.get("X-RateLimit-Reset", "")
        at = datetime.fromtimestamp(now, tz=timezone.utc)
        low = left.isdigit() and int(left) < self.low
        if low:
            self.lines.add("quota", f"{at:%Y-%m-%d %H:%M:%S} {left}")
        try:
            soon = float(reset) - now < self.near
        except ValueError:
            soon = False
        if soon:
            (self.lines.folder / f"requests_before_reset_{at:%Y%m%d_%H%M%S}.txt").write_text(str(self.count()), encoding="utf-8")
        return low


def rotating_log(path: str, size: int = 5 << 20, copies: int = 5) -> logging.Logger:
    """The library's log, into a file that is renamed when it is full; so many old ones are kept."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("noveltide")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handler = RotatingFileHandler(path, maxBytes=size, backupCount=copies, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return log
