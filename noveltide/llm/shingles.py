"""Word shingles of whole texts as 64-bit hashes, computed over Arrow batches with array operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
PIECE = 4_000_000  # bytes of text that are in work at once


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (a run of other bytes than ASCII white space); A-Z are lower-cased."""
    a = np.frombuffer(data.lower(), np.uint8)
    gap = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(1 << max(12, int(len(a)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)]
    return starts, mix((total[ends] - total[starts]) * down[starts])


def _long_words(data: bytes) -> np.ndarray:
    """Word hashes of one long text, worked off in pieces that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        out.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, by text and then by hash.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if len(data) == 1 and len(data[0]) > PIECE:
        words = _long_words(data[0])
        owner = np.zeros(len(words), np.int64)
    else:
        sizes = np.array([len(d) + 1 for d in data], np.int64)
        starts, words = word_hashes(b"\n".join(data))
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    weights = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    count = np.bincount(owner, minlength=len(texts))
    n = len(words)
    full = np.zeros(0, np.int64)
    h = np.zeros(0, np.uint64)
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            h += words[j : n - width + 1 + j] * weights[j]
        full = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
        h = mix(h[full] + np.uint64(width))
    own = owner[full]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        first = np.cumsum(count) - count
        short = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = count[few] > j
            short[has] += words[first[few[has]] + j] * weights[j]
        h = np.r_[h, mix(short + count[few].astype(np.uint64))]
        own = np.r_[own, few]
    h = h.astype(np.int64)
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    keep = np.r_[True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return own[keep], h[keep]


def text_blocks(batch: pa.RecordBatch, column: int, chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about so many characters; a longer text comes alone."""
    texts = batch.column(column).to_pylist()
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop] or "") < chars):
            size += len(texts[stop] or "")
            stop += 1
        yield batch.slice(start, stop - start), texts[start:stop]
        start = stop


def sets_of(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners and hashes as of ``shingle_sets``, set sizes, and a 64-bit fingerprint of each set (0 if empty)."""
    own, h = shingle_sets(texts, width)
    n = np.bincount(own, minlength=len(texts))
    total = np.r_[np.uint64(0), np.cumsum(mix(h.astype(np.uint64) + np.uint64(BASE)), dtype=np.uint64)]
    ends = np.cumsum(n)
    node = mix(total[ends] - total[ends - n] + n.astype(np.uint64)).astype(np.int64)
    return own, h, n, np.where(n > 0, node, 0)
