"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences, and sentences into pieces at content-defined words, so that pieces are short and the same
wherever a passage stands.  Every run of several consecutive pieces is hashed, all runs are joined globally, and the
pieces that any non-first occurrence of a repeated run covers are removed.

A sentence ends at a final punctuation mark before white space, or at a line end.  A piece ends with its sentence, or
after the word with the smallest hash of any ``cut`` consecutive words (the last of them on ties).  A run has
``pieces`` pieces, and more until it has ``words`` words.  So every passage of 50 words holds a whole run, whatever stands
around it: its first and last cut are at most ``cut`` words from its ends, and between them lie at least 26 words, which
are at least three pieces.  Case and white space do not count in comparisons; a character of a script without spaces is
a word.  The first occurrence is the one with the smallest (id, text hash, position); it stays.

Defined results: null and empty texts are kept as they are; rows with the same id and text count as one document and
all get its result; a null id sorts before all others; documents whose pieces all go stay as empty texts; extra columns
are kept (``n_sentences``, the number of pieces, and ``n_removed`` replace columns of these names).
Spans are 64-bit hashes; the chance that two different runs of a corpus of 10^10 runs meet is about three in a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide.llm.common import cut, discard, small_batches
from noveltide.llm.shingles import mix, powers, text_blocks

POINTS = 0x110000
BLOCK = 2_000_000  # characters that are in work at once
# Scripts without spaces between words, and marks that end a sentence (the last ones need no space).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x303F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
ENDS, WIDE_ENDS = ".!?…", "。！？"


@dataclass
class SpanParams:
    pieces: int = 3
    words: int = 16
    cut: int = 12


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its kind (1 white space, 2 a word of its own, 4 ends a sentence before a space, 8 always), and its lower case."""
    kind = np.zeros(POINTS, np.uint8)
    lower = np.arange(POINTS, dtype=np.uint32)
    for c in range(POINTS):
        x = chr(c)
        if x.isspace():
            kind[c] = 1
        y = x.lower()
        if y != x and len(y) == 1:
            lower[c] = ord(y)
    for lo, hi in UNSPACED:
        kind[lo : hi + 1] |= 2
    kind[[ord(x) for x in ENDS]] |= 4
    kind[[ord(x) for x in WIDE_ENDS]] |= 8
    kind[0x3000] = 1
    return kind, lower


@dataclass
class Words:
    """Start (in characters), hash, and whether a sentence ends with it, of each word of a text."""

    start: np.ndarray
    hash: np.ndarray
    ends: np.ndarray


def words_of(text: str) -> Words:
    parts = []
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and not text[end].isspace() and end < at + 2 * BLOCK:
            end += 1
        while end < len(text) and text[end].isspace():  # white space belongs to the word before it
            end += 1
        parts.append(_words(text[at:end], at))
        at = end
    if not parts:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    return Words(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("start", "hash", "ends")))


def _words(text: str, offset: int) -> Words:
    kinds, lower = tables()
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[cps]
    space, alone = (kind & 1) > 0, (kind & 2) > 0
    n = len(cps)
    before = np.r_[True, space[:-1] | alone[:-1]]
    starts = np.flatnonzero(~space & (alone | before))
    if not len(starts):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    # A word ends before the next word or the next white space.
    next_start = np.r_[starts[1:], n]
    spaces = np.flatnonzero(space)
    place = np.searchsorted(spaces, starts)
    next_space = np.r_[spaces, n][place]
    ends = np.minimum(next_start, next_space)
    up, down = powers(1 << max(12, int(n).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum((lower[cps].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)]
    hashes = mix((total[ends] - total[starts]) * down[starts])
    lines = np.r_[0, np.cumsum(cps == 10)]
    gap = next_start > ends
    stop = (kind[ends - 1] & 8 > 0) | gap & ((kind[ends - 1] & 4 > 0) | (lines[next_start] > lines[ends]))
    return Words(starts + offset, hashes, stop)


def pieces_of(w: Words, p: SpanParams) -> np.ndarray:
    """The word after the last of each piece."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    last = w.ends.copy()
    last[-1] = True
    if n >= p.cut:
        for lo in range(0, n - p.cut + 1, BLOCK):
            part = w.hash[lo : lo + BLOCK + p.cut - 1]
            view = np.lib.stride_tricks.sliding_window_view(part, p.cut)[:, ::-1]
            last[lo + np.arange(len(view)) + p.cut - 1 - view.argmin(axis=1)] = True
    return np.flatnonzero(last) + 1


def runs_of(w: Words, ends: np.ndarray, p: SpanParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first piece and number of pieces of every run."""
    k = len(ends)
    begins = np.r_[0, ends[:-1]] if k else ends
    at = np.arange(k)
    stop = np.maximum(at + p.pieces, np.searchsorted(ends, begins + p.words) + 1)
    at = at[stop <= k]
    stop = stop[at]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    n = len(w.hash)
    up, down = powers(1 << max(12, int(n).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(w.hash * up[:n], dtype=np.uint64)]
    lo, hi = begins[at], ends[stop - 1]
    h = mix(mix((total[hi] - total[lo]) * down[lo]) + (hi - lo).astype(np.uint64))
    return h.astype(np.int64), at, stop - at


def remove(text: str, runs: list[tuple[int, int]], p: SpanParams) -> tuple[str, int, int]:
    """The text without the pieces that the runs cover, the number of pieces, and of those removed."""
    w = words_of(text)
    ends = pieces_of(w, p)
    gone = np.zeros(len(ends) + 1, np.int64)
    for first, count in runs:
        gone[first] += 1
        gone[first + count] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    if not gone.any():
        return text, len(ends), 0
    begins = np.r_[0, w.start[ends[:-1]], len(text)]
    edge = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
    kept = [text[begins[a] : begins[z]] for a, z in zip(edge[::2], edge[1::2], strict=True)]
    out = "".join(kept)
    return (out.rstrip() if gone[-1] else out), len(ends), int(gone.sum())


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].alias("_id"), F.xxhash64(df[text_col]).alias("_th"), df[text_col].cast("string").alias("_text"))


def all_spans(df: DataFrame, p: SpanParams, id_col: str, text_col: str) -> DataFrame:
    keyed = _keyed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b, 2, BLOCK):
                found = []
                for i, t in enumerate(texts):
                    if t:
                        w = words_of(t)
                        h, pos, n = runs_of(w, pieces_of(w, p), p)
                        found.append((h, np.full(len(h), i), pos.astype(np.int32), n.astype(np.int32)))
                if found:
                    h, own, pos, n = (np.concatenate(x) for x in zip(*found, strict=True))
                    ids, th = part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([pa.array(h), ids, th, pa.array(pos), pa.array(n)], names=["h", "_id", "_th", "pos", "n"])

    kind = keyed.schema[0].dataType.simpleString()
    return small_batches(keyed).mapInArrow(run, f"h long, _id {kind}, _th long, pos int, n int")


def repeated_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: SpanParams | None = None) -> DataFrame:
    """Every non-first occurrence of a repeated run: ``_id, _th, pos, n``."""
    found = cut(all_spans(df, params or SpanParams(), id_col, text_col), "spans")
    # Counted keys are written before they are joined: only then can a join deal out a hot key's rows anew.  Rows that
    # repeat as a whole count here, but their runs stand where the first ones do.
    seen = cut(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "seen")
    again = cut(found.join(seen, "h", "left_semi"), "again")
    discard(found, seen)
    place = F.struct("_id", "_th", "pos")
    first = cut(again.groupBy("h").agg(F.min(place).alias("first")), "first")
    return again.join(first, "h").where(~place.eqNullSafe(F.col("first"))).select("_id", "_th", "pos", "n")


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: SpanParams | None = None) -> DataFrame:
    """``df`` with covered pieces removed from ``text_col``, and ``n_sentences`` and ``n_removed`` (long)."""
    p = params or SpanParams()
    runs = repeated_runs(df, id_col=id_col, text_col=text_col, params=p)
    per_doc = runs.groupBy(F.col("_id").alias("_id2"), F.col("_th").alias("_th2")).agg(F.collect_set(F.struct("pos", "n")).alias("_runs"))  # bounded by the document
    # The columns travel in a struct, where nothing can clash with them.
    names = [c for c in df.columns if c not in ("n_sentences", "n_removed")]
    row = F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(names) if c != text_col], F.lit(0).alias("_"))
    own = df.select(row.alias("_row"), df[id_col].alias("_id"), F.xxhash64(df[text_col]).alias("_th"), df[text_col].cast("string").alias("_text"))
    rows = own.join(per_doc, own["_id"].eqNullSafe(per_doc["_id2"]) & (own["_th"] == per_doc["_th2"]), "left").select("_row", "_text", "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b, 1, 2 * BLOCK):
                new, sizes, removed = [], [], []
                for t, r in zip(texts, part.column(2), strict=True):
                    runs = [(x["pos"], x["n"]) for x in r.as_py()] if r.is_valid else []
                    text, n, gone = remove(t, runs, p) if t else (t, 0, 0)
                    new.append(text)
                    sizes.append(n)
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["_row", "_text", "n_sentences", "n_removed"])

    out = small_batches(rows).mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, n_sentences long, n_removed long")
    kept = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*kept, "n_sentences", "n_removed")
