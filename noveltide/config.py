"""Behavioural parameters of the scientometric pipeline, and its folder layout (nothing is created on import)."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class HarvestConfig:
    years: range = range(1826, 2025)
    page_size: int = 25
    max_pages: int = 199
    empty_pages: int = 3
    attempts: int = 5
    sleep_start: float = 1.0
    sleep_least: float = 0.1
    sleep_most: float = 10.0
    speed_up_after: int = 50
    slow_down_after: int = 3
    short_pause: tuple[int, float] = (500, 300.0)
    long_pause: tuple[int, float] = (3000, 3600.0)
    warm_up: float = 300.0
    query: str = "SUBJAREA(MATH) AND DOCTYPE(ar) AND PUBYEAR IS {year}"

    @property
    def offset_cap(self) -> int:
        """Hits that offset paging can reach; beyond them a cursor is needed."""
        return self.page_size * self.max_pages


@dataclass(frozen=True)
class EnrichConfig:
    corpus_size: int = 3_640_783
    weekly_quota: int = 150_000
    test_quota: int = 2
    merge_every: int = 500
    attempts: int = 5
    per_request: float = 1 / 9
    subject_codes: tuple[int, int] = (2602, 2614)
    nameless: str = "(sin nombre)"


@dataclass(frozen=True)
class TextConfig:
    abstract_confidence: float = 0.60
    least_words: int = 4
    target: str = "en"
    undetected: str = "(sin_deteccion)"
    bigram_min_count: int = 30
    bigram_threshold: float = 60.0


@dataclass(frozen=True)
class VectorConfig:
    size: int = 200
    window: int = 10
    min_count: int = 2
    epochs: int = 12
    sg: int = 1
    vocab_thresholds: tuple[int, ...] = (1, 2, 3, 5, 8, 10)
    sample: int = 5000
    seed: int = 42
    encoder_batch: int = 256
    encoder_tokens: int = 512


@dataclass(frozen=True)
class NoveltyConfig:
    years: int = 5
    norm_floor: float = 1e-12
    sum_floor: float = 1e-9


@dataclass(frozen=True)
class Layout:
    """Where the stages keep their files."""

    root: str
    folders: tuple[str, ...] = ("raw", "metadata", "enriched", "filtered", "tokens", "models", "vectors", "novelty", "reports", "state")

    def path(self, folder: str, *names: str) -> str:
        if folder not in self.folders:
            raise ValueError(f"no folder {folder!r} in the layout")
        return "/".join([self.root.rstrip("/"), folder, *names])


@dataclass(frozen=True)
class Credentials:
    """API keys; they stay on the driver and never enter a DataFrame."""

    key: str = field(repr=False)
    token: str = field(repr=False, default="")

    @classmethod
    def from_env(cls, key: str = "API_KEY", token: str = "INST_TOKEN") -> Credentials:
        if not os.environ.get(key):
            raise RuntimeError(f"environment variable {key} is not set")
        return cls(os.environ[key], os.environ.get(token, ""))

    def headers(self) -> dict[str, str]:
        return {"X-ELS-APIKey": self.key, "X-ELS-Insttoken": self.token, "Accept": "application/json"}
