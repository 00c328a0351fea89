"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts are word sequences.  An item of n words leaks into a document if the document holds a run of words within
``int(max_edits * n)`` word edits of it.  Windows of the item's size are embedded by the CGK random walk (at step j
the current word is written and the pointer moves on by a random bit of (j, word)), which maps edit distance to Hamming
distance; positions of the embedding are sampled and hashed, with a new walk in each repetition.  Each length of items
has as many repetitions as its worst item needs to reach the target recall at the largest distance (measured on edited
items); if ``most_repetitions`` do not reach it, fewer positions are sampled, and if one is still too many, all items of
that length with enough word triples in the document are candidates.  Candidates are verified by the exact edit
distance.  Windows that cannot hold an item, because too few of their word triples (for five words: pairs) occur in any
item of the size, are never embedded; that loses nothing, as an edit destroys three at most.  Items so short that no
edit is allowed are found as exact word runs.

The benchmark is the stated query set: it is worked off in blocks of about ``block_words`` words, each against all
documents.  What is sent to the workers of a block takes some 100 bytes a word (50 MB), whatever the size of the benchmark.

Defined results: null or empty texts and items match nothing, nor do items without words; equal items each get their
row; repeated documents each get theirs; of several places of an item in a document the one with the fewest edits
counts, the first of those on ties; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide.llm.common import small_batches

WORD = re.compile(r"\w+")
SLOTS = 1 << 22  # of the table of word triples and pairs; a clash only lets more windows through


@dataclass
class CgkParams:
    max_edits: float = 0.2
    sampled: int = 3
    target_recall: float = 0.99
    most_repetitions: int = 64
    seed: int = 7
    block_words: int = 500_000


def coins(words: np.ndarray, block: int, rep: int, seed: int) -> np.ndarray:
    """64 random bits for each word: of the walk's steps ``64 * block`` and on, in a repetition."""
    x = words.astype(np.uint64) + np.uint64((block * 0x9E3779B97F4A7C15 + rep * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walk(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """What the walks over the windows from ``starts`` to ``ends`` write at each step: a row per step, -2 beyond the end."""
    longest = int((ends - starts).max(initial=1))
    out = np.full((2 * longest, len(starts)), -2, np.int64)
    at = starts.copy()
    for j in range(2 * longest):
        if j % 64 == 0:
            flips = coins(text, j // 64, rep, seed)
        inside = at < ends
        here = np.where(inside, at, 0)
        out[j] = np.where(inside, text[here], -2)
        at += ((flips[here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return out


def edits(item: list[int], text: list[int]) -> tuple[int, int]:
    """The fewest word edits between the item and any run of the text, and the run's end (bit-parallel)."""
    n = len(item)
    mask, last = (1 << n) - 1, 1 << (n - 1)
    eq: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item):
        eq[w] |= 1 << k
    pv, mv, score, best, end = mask, 0, n, n, 0
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        d0 = (((e & pv) + pv) ^ pv) | e | mv
        hp, hn = mv | (~(d0 | pv) & mask), pv & d0
        score += 1 if hp & last else -1 if hn & last else 0
        hp, hn = (hp << 1) & mask, (hn << 1) & mask
        pv, mv = hn | (~(d0 | hp) & mask), hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mixed(out + c.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def expand(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``asked`` of those that are among the sorted ``keys``, and the values there (several each)."""
    lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
    count = hi - lo
    place = np.repeat(np.arange(len(asked)), count)
    return place, values[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(place))]


class Index:
    """The items of a block: word numbers, tables of triples and pairs, signatures by repetition."""

    def __init__(self, items: list[tuple[object, str]], p: CgkParams):
        self.p = p
        self.vocab: dict[str, int] = {}
        self.ids, texts = [], []
        for key, text in items:
            words = WORD.findall(text.lower())
            if words:
                self.ids.append(key)
                texts.append([self.vocab.setdefault(w, len(self.vocab)) for w in words])
        self.flat = np.array([w for x in texts for w in x], np.int32)
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.limit = {int(n): int(p.max_edits * n) for n in np.unique(self.sizes)}
        # Each length goes by triples, by pairs, or (0) by all its windows; without an edit, by whole runs.
        self.runs = [n for n, k in self.limit.items() if k == 0]
        self.width = {n: 3 if n - 2 - 3 * k > 0 else 2 if n - 1 - 2 * k > 0 else 0 for n, k in self.limit.items() if k}
        self.need = {n: n - w + 1 - w * self.limit[n] if w else 0 for n, w in self.width.items()}
        self.run_tables = {n: self._sorted(*self._grams(n, [n])) for n in self.runs}
        self.gram_tables = {}  # by width: slots and the lengths of items that have them; and for lengths without walks, the items
        self.repetitions, self.sampled = self._repetitions()
        self.by_grams = [n for n in self.width if not self.repetitions[n] and self.width[n]]
        self.item_tables = {}
        for w in (3, 2):
            lengths = [n for n in self.width if self.width[n] == w]
            slot, item = self._grams(w, lengths)
            slot = self.slots_of(slot)
            pairs = np.unique(slot.astype(np.int64) << 32 | self.sizes[item])
            self.gram_tables[w] = ((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))
            few = np.isin(self.sizes[item], self.by_grams)
            self.item_tables[w] = self._sorted(slot[few], item[few])
        self.steps: list[dict[int, np.ndarray]] = []
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for rep in range(max(self.repetitions.values(), default=0)):
            share = np.sort(np.random.default_rng([p.seed, rep]).random(p.sampled))
            self.steps.append({n: (np.resize(share[: self.sampled[n]], p.sampled) * 2 * n).astype(np.int64) for n, r in self.repetitions.items() if r > rep})
            some = np.flatnonzero(np.isin(self.sizes, list(self.steps[-1])))
            keys = self.signatures(self.flat.astype(np.int64), self.starts[some], self.sizes[some], self.starts[some] + self.sizes[some], rep)
            self.tables.append(self._sorted(keys, some))
        self._known: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((values, keys))
        return keys[order], values[order].astype(np.int32)

    def item(self, i: int) -> list[int]:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]].tolist()

    def _grams(self, w: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and item of every run of w words in the items of these lengths."""
        some = np.flatnonzero(np.isin(self.sizes, lengths) & (self.sizes >= w))
        per = self.sizes[some] - w + 1
        item = np.repeat(some, per)
        at = np.repeat(self.starts[some] - (np.cumsum(per) - per), per) + np.arange(len(item))
        return hashed([self.flat[at + j] for j in range(w)]) if len(at) else np.zeros(0, np.uint64), item

    @staticmethod
    def slots_of(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(SLOTS - 1)).astype(np.int32)

    def known(self, w: int) -> np.ndarray:
        """Whether a slot holds a run of w words of an item (worked out in each process)."""
        if w not in self._known:
            self._known[w] = np.zeros(SLOTS, bool)
            self._known[w][self.gram_tables[w][0]] = True
        return self._known[w]

    def signatures(self, text: np.ndarray, begin: np.ndarray, n: np.ndarray, end: np.ndarray, rep: int) -> np.ndarray:
        """Hashes of what the walks over these windows (of items of n words) write at the sampled steps."""
        written = walk(text, begin, end, rep, self.p.seed)
        lengths, which = np.unique(n, return_inverse=True)
        steps = np.array([self.steps[rep][int(x)] for x in lengths]).reshape(len(lengths), -1)[which]
        return hashed([n, *(written[np.minimum(steps[:, j], len(written) - 1), np.arange(len(n))] for j in range(steps.shape[1]))])

    def _repetitions(self) -> tuple[dict[int, int], dict[int, int]]:
        """For each length the repetitions that meet its worst item, with the most edits allowed, with the target
        probability, and the positions sampled; no repetitions if too many are needed."""
        rng, spans = np.random.default_rng(self.p.seed), {}
        pairs: list[tuple[list[int], list[int]]] = []
        for n in self.width:
            some = rng.permutation(np.flatnonzero(self.sizes == n))[:4]
            spans[n] = (len(pairs), len(some))
            for i in some:
                x = self.item(int(i))
                for _ in range(8):
                    y = list(x)
                    for _ in range(self.limit[n]):
                        at, kind = int(rng.integers(len(y))), int(rng.integers(3))
                        y[at : at + (kind != 0)] = [] if kind == 1 else [-3 - int(rng.integers(1 << 30))]
                    pairs.append((x, [*y, *([-1] * n)][:n]))
        agree = np.zeros(len(pairs))
        for lo in range(0, len(pairs), 2000):
            part = pairs[lo : lo + 2000]
            size = np.array([len(x) for x, _ in part])
            text = np.array([w for side in (0, 1) for pair in part for w in pair[side]], np.int64)
            begin = np.cumsum(size) - size
            for rep in range(2):
                a = walk(text, begin, begin + size, rep, self.p.seed)
                b = walk(text, begin + int(size.sum()), begin + size + int(size.sum()), rep, self.p.seed)
                for k, n in enumerate(size):
                    agree[lo + k] += float(np.mean(a[: 2 * n, k] == b[: 2 * n, k])) / 2
        repetitions, sampled = {}, {}
        for n, (lo, items) in spans.items():
            repetitions[n], sampled[n] = 0, 1
            for many in range(self.p.sampled, 0, -1):
                share = float((agree[lo : lo + 8 * items] ** many).reshape(items, 8).mean(axis=1).min())
                wanted = 1 if share >= 1 else math.ceil(math.log(1 - self.p.target_recall) / math.log(1 - max(share, 1e-9)))
                if wanted <= self.p.most_repetitions:
                    repetitions[n], sampled[n] = max(8, wanted), many
                    break
            if not self.width[n] and not repetitions[n]:
                repetitions[n] = wanted  # nothing else tells its windows
        return repetitions, sampled

    def windows(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and sizes of the windows that could hold an item; and, of lengths without walks, starts and items.

        ``first`` and ``last``: each word's document's bounds.
        """
        starts, sizes, at_starts, at_items = [], [], [], []
        for w, (slots, lengths) in self.gram_tables.items():
            if not len(slots) or len(words) < w:
                continue
            ok = (words[: len(words) - w + 1] >= 0) & (first[: len(words) - w + 1] == first[w - 1 :])
            for j in range(1, w):
                ok &= words[j : len(words) - w + 1 + j] >= 0
            at = np.flatnonzero(ok)
            slot = self.slots_of(hashed([words[at + j] for j in range(w)])) if len(at) else np.zeros(0, np.int32)
            hit = self.known(w)[slot]
            at, slot = at[hit], slot[hit]
            place, n_of = expand(slots, lengths, slot)
            order = np.argsort(n_of, kind="stable")
            found, bounds = at[place[order]], np.searchsorted(n_of[order], [[n, n + 1] for n in self.width])
            for n, (lo, hi) in zip(self.width, bounds.tolist(), strict=True):
                if self.width[n] != w or hi - lo < self.need[n] or not self.repetitions[n]:
                    continue
                q, k, need = found[lo:hi], self.limit[n], self.need[n]
                a, z = q[: len(q) - need + 1], q[need - 1 :]
                ok = (z - a <= n + k - w) & (first[a] == first[z])
                a, z = a[ok], z[ok]
                if len(a):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.maximum(first[a], z - (n + k - w)), 1)
                    np.add.at(change, a + 1, -1)
                    starts.append(np.flatnonzero(np.cumsum(change)[:-1]))
                    sizes.append(np.full(len(starts[-1]), n))
            place, item = expand(*self.item_tables[w], slot)
            if len(place):
                # Of each document and item, so many runs must be there at least.
                doc, item = first[at[place]], item.astype(np.int64)
                key = doc * len(self.sizes) + item
                _, back, count = np.unique(key, return_inverse=True, return_counts=True)
                ok = count[back] >= np.array([self.need.get(int(n), 0) for n in self.sizes[item]])
                at_starts.append(at[place][ok])
                at_items.append(item[ok])
        for n, w in self.width.items():
            if not w:
                starts.append(np.arange(len(words)))
                sizes.append(np.full(len(words), n))
        none = [np.zeros(0, np.int64)]
        start, size = np.concatenate(starts or none), np.concatenate(sizes or none)
        ok = last[start] - start >= size - np.array([self.limit[int(n)] for n in np.unique(size)] or [0])[np.unique(size, return_inverse=True)[1]] if len(start) else np.zeros(0, bool)
        return start[ok], size[ok], np.concatenate(at_starts or none), np.concatenate(at_items or none)

    def whole_runs(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Starts and items of exact runs, for items of which no word may be edited."""
        for n in self.runs:
            if len(words) < n:
                continue
            ok = (words[: len(words) - n + 1] >= 0) & (first[: len(words) - n + 1] == first[n - 1 :])
            at = np.flatnonzero(ok)
            at = at[(words[at[:, None] + np.arange(n)] >= 0).all(axis=1)]
            if len(at):
                place, item = expand(*self.run_tables[n], hashed([words[at + j] for j in range(n)]))
                for q, i in zip(at[place].tolist(), item.tolist(), strict=True):
                    if words[q : q + n].tolist() == self.item(i):
                        yield q, i

    def find(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, edits, first word, end word) of the items that leak into documents of these word numbers."""
        lens = np.array([len(d) for d in docs], np.int64)
        if not lens.sum() or not len(self.sizes):
            return
        words, ends = np.concatenate(docs), np.cumsum(lens)
        doc = np.repeat(np.arange(len(docs)), lens)
        first, last = (ends - lens)[doc], ends[doc]
        exact: dict[tuple[int, int], int] = {}
        for q, i in self.whole_runs(words, first):
            exact.setdefault((int(doc[q]), i), q)
        starts, sizes, at_starts, at_items = self.windows(words, first, last)
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        for q, i in zip(at_starts.tolist(), at_items.tolist(), strict=True):
            near[int(doc[q]), i].update((max(int(first[q]), q - int(self.sizes[i]) - self.limit[int(self.sizes[i])]), q))
        for lo in range(0, len(starts), 20_000):
            at, n = starts[lo : lo + 20_000], sizes[lo : lo + 20_000]
            # The walks need the words of the windows alone.
            part, inverse = np.unique((at[:, None] + np.arange(int(n.max()))).ravel(), return_inverse=True)
            text = words[np.minimum(part, len(words) - 1)]
            begin = inverse.reshape(len(at), -1)[:, 0]
            end = begin + np.minimum(n, last[at] - at)
            many = np.array([self.repetitions[int(x)] for x in np.unique(n)])[np.unique(n, return_inverse=True)[1]]
            for rep, table in enumerate(self.tables):
                live = np.flatnonzero(many > rep)
                if not len(live):
                    break
                place, item = expand(*table, self.signatures(text, begin[live], n[live], end[live], rep))
                for k, i in zip(live[place].tolist(), item.tolist(), strict=True):
                    near[int(doc[at[k]]), i].add(int(at[k]))
        for (d, i), q in exact.items():
            base = int(ends[d] - lens[d])
            yield d, i, 0, q - base, q - base + int(self.sizes[i])
        for (d, i), found in sorted(near.items()):
            item, n = self.item(i), int(self.sizes[i])
            k, best, base, stop = self.limit[n], None, int(ends[d] - lens[d]), int(ends[d])
            for a, z in stretches(sorted(found), n + k):
                lo = max(base, a - k)
                text = words[lo : min(stop, z + n + 2 * k)].tolist()
                cost, end = edits(item, text)
                if cost <= k and (best is None or cost < best[0]):
                    _, size = edits(item[::-1], text[max(0, end - n - k) : end][::-1])
                    best = (cost, lo + end - size - base, lo + end - base)
            if best:
                yield d, i, *best


def stretches(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    first = last = starts[0]
    for s in starts[1:]:
        if s > last + gap:
            yield first, last
            first = s
        last = s
    yield first, last


def blocks(benchmark: DataFrame, item_col: str, text_col: str, words: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items, dealt by a hash into blocks of about so many words, one block in memory at a time."""
    rows = benchmark.select(benchmark[item_col].alias("k"), benchmark[text_col].cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.char_length("t")).alias("n")).first().n or 0
    many = -(-size // (5 * words))
    for b in range(many):
        yield sorted(((r.k, r.t) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(many)) == b).collect()), key=lambda x: (x[1], x[0] is None, x[0]))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: CgkParams | None = None) -> DataFrame:
    """``id, item, edits, n_words, start_word, end_word`` for every document and item that leaks into it."""
    p = params or CgkParams()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    item_type = benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{item_col}` {item_type.simpleString()}, edits long, n_words long, start_word long, end_word long"
    parts = [_leaks_of(rows, Index(block, p), schema) for block in blocks(benchmark, item_col, item_text_col, p.block_words)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _leaks_of(rows: DataFrame, index: Index, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shared = rows.sparkSession.sparkContext.broadcast(index)  # bounded by block_words
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        number = index.vocab.get
        for b in batches:
            texts = b.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < 2_000_000):
                    size += len(texts[stop] or "")
                    stop += 1
                docs = [np.fromiter((number(w, -1) for w in WORD.findall(t.lower())), np.int64) if t else np.zeros(0, np.int64) for t in texts[start:stop]]
                out = list(index.find(docs))
                if out:
                    at, item, d, first, end = zip(*out, strict=True)
                    cols = [b.column(0).take(pa.array([start + k for k in at])), pa.array([index.ids[i] for i in item]), pa.array(d), pa.array(index.sizes[list(item)]), pa.array(first), pa.array(end)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
                start = stop

    return small_batches(rows).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaks, told apart by id and text."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key = F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("text"))
    keyed = docs.select(key.alias("_key"), docs[text_col].alias("_text"))
    hit = leaks(keyed, benchmark, **options | {"id_col": "_key", "text_col": "_text"}).select("_key").distinct()
    same = docs[id_col].eqNullSafe(hit["_key.id"]) & (F.xxhash64(docs[text_col].cast("string")) == hit["_key.text"])
    return docs.join(hit, same, "left_anti")
