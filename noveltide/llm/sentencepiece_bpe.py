"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs.  A text is cut into segments that no vocabulary piece can
span, every distinct segment is encoded once by the agenda (vectorised over many short segments, a heap for long
ones), and the sentencepiece library encodes and decodes the same segments in the same Arrow batch as a check.
Should the two ever differ, the library's ids are used and the difference is counted in ``n_mismatch``.

Defined results: a null text counts as empty; an empty text has no ids but the end id; repeated rows give repeated
results; columns other than the two named are not read.  Memory is bounded by one Arrow batch and a segment cache of
``cache_segments`` entries.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noveltide.llm.common import small_batches

NONE = np.iinfo(np.int32).max
SPACE = "▁"


class MergeModel:
    """The merge table of a model file: which adjacent symbols join to which piece, and in what order."""

    #: Segments of up to this many symbols are merged together in matrices; longer ones use the heap.
    SHORT = 24

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.unk, self.eos = lib.unk_id(), lib.eos_id()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.byte_set = frozenset(self.byte_of)
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.id_of = {self.pieces[i]: i for i in plain}
        scores = np.array([lib.get_score(i) for i in range(n)])
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in plain}, reverse=True))}
        self.rank = np.full(n, NONE, np.int32)
        for i in plain:
            self.rank[i] = order[scores[i]]
        self.oov = n  # stands for any character without a piece; merges with nothing
        self.char_id = np.full(0x110000, self.oov, np.int32)
        for i in plain:
            if len(self.pieces[i]) == 1:
                self.char_id[ord(self.pieces[i])] = i
        keys, joined = [], []
        for i in plain:
            p = self.pieces[i]
            for k in range(1, len(p)):
                left, right = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * (n + 1) + right)
                    joined.append(i)
        self.base = n + 1
        self._build(np.array(keys, np.int64), np.array(joined, np.int32))
        inside = {c for i in plain if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece holds a space after another character: segments would not be independent")
        alone = "".join(re.escape(c) for c in map(chr, range(0x250)) if c not in inside and c != " ")
        self.cut = re.compile(f" *[^ {alone}]+| +|[{alone}]" if alone else " *[^ ]+| +")

    def _build(self, keys: np.ndarray, joined: np.ndarray) -> None:
        """An open-addressing table for vectorised lookups."""
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.shift = (1 << bits) - 1, 64 - bits
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        todo, at, probe = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.vals[at[won]] = keys[todo[won]], joined[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at, probe = todo[rest], (at[rest] + 1) & self.mask, probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of adjacent symbols joins to, or -1."""
        key = left.astype(np.int64) * self.base + right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.vals[at], -1)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        j = self.joins(left, right)
        return np.where(j >= 0, self.rank[j], NONE)

    def agenda(self, segment: str) -> list[int]:
        """One segment by a heap of (score rank, position) over a linked list of symbols."""
        chars = [SPACE if c == " " else c for c in segment]
        sym, n = list(chars), len(chars)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                i = self.id_of.get(sym[a] + sym[b])
                if i is not None and sym[a] in self.id_of and sym[b] in self.id_of:
                    heapq.heappush(heap, (int(self.rank[i]), a, b, sym[a] + sym[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or right[a] != b or sym[a] + sym[b] != joined:
                continue
            sym[a], sym[b] = joined, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return self.ids_of([s for s in sym if s is not None])

    def ids_of(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.id_of.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode("utf-8")]
            else:
                out.append(self.unk)
        return out

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(segments)
        lens = np.fromiter(map(len, segments), np.int64, len(segments))
        for lo, hi in ((0, 4), (4, 7), (7, 10), (10, 14), (14, 18), (18, self.SHORT)):
            at = np.flatnonzero((lens > lo) & (lens <= hi))
            for k in range(0, len(at), 50_000):
                part = at[k : k + 50_000]
                for i, ids in zip(part.tolist(), self._merge([segments[i] for i in part.tolist()], lens[part], hi), strict=True):
                    out[i] = ids
        return [self.agenda(segments[i]) if x is None else x for i, x in enumerate(out)]

    def _merge(self, segments: list[str], lens: np.ndarray, width: int) -> list[list[int]]:
        """All short segments at once: in each round every row joins its best pair, leftmost on ties."""
        cps = np.frombuffer("".join(segments).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        n, cols = len(segments), np.arange(width)
        m = np.full((n, width), -1, np.int32)
        inside = cols < lens[:, None]
        m[inside] = self.char_id[cps]
        oov = (m == self.oov).any(axis=1)
        r = np.full((n, width), NONE, np.int32)  # r[:, k]: rank of the pair k, k + 1
        pair = inside[:, 1:]
        r[:, :-1][pair] = self.ranks(m[:, :-1][pair], m[:, 1:][pair])
        size, live, done = lens.copy(), np.arange(n), np.full((n, width), -1, np.int32)
        while len(live):
            best = r.argmin(axis=1)
            rows = np.arange(len(live))
            over = r[rows, best] == NONE
            if over.any():
                done[live[over]] = m[over]
                keep = ~over
                live, m, r, best = live[keep], m[keep], r[keep], best[keep]
                rows = np.arange(len(live))
                if not len(live):
                    break
            new = self.joins(m[rows, best], m[rows, best + 1])
            after = cols[:-1] > best[:, None]
            m[:, :-1][after] = m[:, 1:][after]
            r[:, :-1][after] = r[:, 1:][after]
            m[:, -1], r[:, -1] = -1, NONE
            m[rows, best] = new
            size[live] -= 1
            r[rows, best] = NONE
            k = np.flatnonzero(best + 1 < size[live])
            r[k, best[k]] = self.ranks(new[k], m[k, best[k] + 1])
            k = np.flatnonzero(best > 0)
            r[k, best[k] - 1] = self.ranks(m[k, best[k] - 1], new[k])
        out = [row[:s] for row, s in zip(done.tolist(), size.tolist(), strict=True)]
        for i in np.flatnonzero(oov).tolist():  # characters without a piece: bytes, found by walking the text
            ids, text, at = [], segments[i].replace(" ", SPACE), 0
            for x in out[i]:
                if x == self.oov:
                    ids += self.ids_of([text[at]])
                    at += 1
                else:
                    ids.append(x)
                    at += len(self.pieces[x])
            out[i] = ids
        return out

    def surface(self, ids: list[int]) -> str:
        """The text of a segment's ids, spaces kept; runs of byte pieces are read as UTF-8."""
        if self.byte_set.isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(run.decode("utf-8", "replace"))
            run.clear()
            out.append(self.shown[i] if i >= 0 else "")
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> MergeModel:
    return MergeModel(path)


class SegmentCache:
    """Segments that were encoded and checked: id bytes (int32) and decoded text."""

    def __init__(self, model: MergeModel, most: int):
        self.model, self.most = model, most
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.bad: set[str] = set()

    def learn(self, segments: list[str]) -> None:
        if not segments:
            return
        m = self.model
        own = m.encode_segments(segments)
        shown = list(map(m.surface, own))
        # The library puts a space in front of any text; a segment that starts with one is handed over without it.
        # For another, a line break shields it from that space: no piece spans a line break.
        spaced = [i for i, s in enumerate(segments) if s[0] == " " and len(s) > 1]
        rest = [i for i, s in enumerate(segments) if s[0] != " "]
        theirs = own.copy()
        for i, ids in zip(spaced, m.lib.encode([segments[i][1:] for i in spaced], num_threads=1), strict=True):
            theirs[i] = ids
        lead = m.lib.encode("\n")
        for i, ids in zip(rest, m.lib.encode(["\n" + segments[i] for i in rest], num_threads=1), strict=True):
            theirs[i] = ids[len(lead) :]
        if own != theirs:
            for i, (x, y) in enumerate(zip(own, theirs, strict=True)):
                if x != y:
                    self.bad.add(segments[i])
                    own[i], shown[i] = y, m.surface(y)
        if m.lib.decode(lead + list(chain.from_iterable(own))) != "\n" + "".join(shown):  # all at once; one by one only to find a difference
            for i, ids in enumerate(own):
                if (text := m.lib.decode(lead + ids).removeprefix("\n")) != shown[i]:
                    self.bad.add(segments[i])
                    shown[i] = text
        self.text.update(zip(segments, shown, strict=True))
        self.ids.update(zip(segments, (array("i", ids).tobytes() for ids in own), strict=True))

    def trim(self) -> None:
        if len(self.ids) > self.most:
            self.ids.clear()
            self.text.clear()
            self.bad.clear()


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, eos: bool, cache_segments: int) -> Iterator[pa.RecordBatch]:
    model = load(path)
    cache = SegmentCache(model, cache_segments)
    tail = np.array([model.eos] if eos else [], "<i4").tobytes()
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        # Blocks of a few MB of text, however many rows an Arrow batch has.
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < 2_000_000):
                chars += len(texts[stop] or "")
                stop += 1
            split = [model.cut.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts[start:stop]]
            cache.trim()
            known = cache.ids
            cache.learn([s for s in dict.fromkeys(x for segs in split for x in segs) if s not in known])
            ids, decoded, sizes, wrong = [], [], [0], []
            for segs in split:
                ids += map(known.__getitem__, segs)
                ids.append(tail)
                sizes.append(sum(map(len, map(known.__getitem__, segs))) // 4 + len(tail) // 4)
                decoded.append("".join(map(cache.text.__getitem__, segs)).removeprefix(" "))
                wrong.append(sum(s in cache.bad for s in segs) if cache.bad else 0)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), lists, pa.array(decoded, pa.string()), pa.array(wrong, pa.int64())], names=[batch.schema.names[0], "ids", "decoded", "n_mismatch"])
            start = stop


def encode(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", add_eos: bool = True, cache_segments: int = 300_000) -> DataFrame:
    """Ids and decoded text of every row: ``id_col, ids array<int>, decoded string, n_mismatch long``."""
    pair = df.select(df[id_col], df[text_col].cast("string").alias("_text"))
    kind = pair.schema[0].dataType.simpleString()
    run = lambda it: encode_batches(it, model_path, add_eos, cache_segments)
    return small_batches(pair).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string, n_mismatch long")
