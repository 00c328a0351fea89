"""Language identification by string kernels.

Texts are compared by a blended-spectrum presence kernel: the number of distinct character n-grams (of several n) that
two texts share, over the geometric mean of their own numbers.  Nystrom landmarks turn the kernel into a short feature
vector, one-versus-rest kernel ridge regression is solved on it, and texts are scored by batched matrix products: a
presence matrix times the landmarks' matrix times the coefficients.  Long texts are read in chunks, all of which count.
N-grams are told apart exactly, so the kernel is exact.

Defined results: null texts and texts without letters get ``und`` and score 0; without labelled rows every text gets
that; rows with a null language teach nothing; ties go to the language that sorts first; repeated rows give repeated
results.  Training reads the whole texts of at most ``per_lang`` rows of a language; a landmark is a chunk of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noveltide.llm.common import cut, discard, small_batches

UNDETERMINED = "und"
CELLS = 1 << 23  # of a presence matrix that is in memory at once


@dataclass
class KernelParams:
    """``ns``: at most three.  ``ridge``: per training chunk.  ``landmarks``: in all, shared by languages."""

    ns: tuple[int, ...] = (1, 2, 3)
    chunk: int = 2000
    landmarks: int = 96
    ridge: float = 1e-4
    per_lang: int = 300
    dense_alphabet: int = 160  # up to so many letters, n-grams are looked up in a table, else by search


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-case code points; a run of other characters than letters is one 32."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cps]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, cps, 32)[keep].astype(np.int64)


@dataclass
class Chunks:
    """The chunks of some texts: the text and size of each, all code points, and the chunk and text of each of them."""

    owner: np.ndarray
    weight: np.ndarray
    flat: np.ndarray
    chunk: np.ndarray
    doc: np.ndarray


def chunks_of(texts: list[str], p: KernelParams) -> Chunks:
    codes = [_codes(t) for t in texts]
    lens = np.array([len(c) for c in codes], np.int64)
    per = np.maximum(1, np.rint(lens / p.chunk).astype(np.int64)) * (lens > 0)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    size = np.where(per > 0, -(-lens // np.maximum(per, 1)), 1)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    doc = np.repeat(np.arange(len(texts)), lens)
    chunk = np.repeat(np.cumsum(per) - per, lens) + within // size[doc]
    owner = np.repeat(np.arange(len(texts)), per)
    return Chunks(owner, np.bincount(chunk, minlength=len(owner)).astype(float), flat, chunk, doc)


def n_grams(c: Chunks, symbols: np.ndarray, base: int, n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, number to the base, and whether all symbols are known (not 0), of the n-grams that start from lo to hi."""
    at = np.arange(lo, min(hi, len(symbols) - n + 1))
    at = at[c.doc[at] == c.doc[at + n - 1]] if len(at) else at
    code, known = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j in range(n):
        s = symbols[at + j]
        code = code * base + s
        known &= s > 0
    return at, code, known


def distinct(chunk: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (chunk, code) once, by chunk and then by code."""
    order = np.lexsort((code, chunk))
    chunk, code = chunk[order], code[order]
    keep = np.ones(len(order), bool)
    keep[1:] = (chunk[1:] != chunk[:-1]) | (code[1:] != code[:-1])
    return chunk[keep], code[keep]


POINTS = 0x110000  # a base that no code point reaches: three fit into 63 bits


class Vocabulary:
    """The n-grams of the landmarks, and for any text the presence of these and the number of all its n-grams."""

    def __init__(self, texts: list[str], p: KernelParams):
        self.p = p
        c = chunks_of(texts, p)
        found = [n_grams(c, c.flat, POINTS, n, 0, len(c.flat))[1] for n in p.ns]
        self.codes = [np.unique(x) for x in found]  # one sorted array for each n
        self.starts = np.cumsum([0, *map(len, self.codes)])
        alphabet = np.unique(c.flat)
        self.base = len(alphabet) + 1
        self.lut = np.zeros(POINTS, np.int32)
        self.lut[alphabet] = np.arange(1, self.base)
        self.dense = self.base <= p.dense_alphabet
        if self.dense:
            self.offsets = np.cumsum([0, *(self.base**n for n in p.ns)])
            self.cells = np.concatenate([self.offsets[i] + self._renumbered(x, n) for i, (n, x) in enumerate(zip(p.ns, self.codes, strict=True))])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def _renumbered(self, code: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(code), np.int64)
        for j in reversed(range(n)):
            out = out * self.base + self.lut[code // POINTS**j % POINTS]
        return out

    def presence(self, c: Chunks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of chunks: the first, a row of presences per chunk, and the numbers of distinct n-grams."""
        rows = max(1, CELLS // int(self.offsets[-1] if self.dense else max(1, len(self))))
        symbols = self.lut[c.flat].astype(np.int64)
        edges = np.searchsorted(c.chunk, np.arange(0, len(c.owner) + rows, rows))
        for b, first in enumerate(range(0, len(c.owner), rows)):
            lo, hi, k = edges[b], edges[b + 1], min(rows, len(c.owner) - first)
            total = np.zeros(k, np.int64)
            if self.dense:
                here = np.zeros((k, int(self.offsets[-1])), bool)
            else:
                here = np.zeros((k, len(self)), bool)
            for i, n in enumerate(self.p.ns):
                at, code, known = n_grams(c, symbols, self.base, n, lo, hi)
                row = c.chunk[at] - first
                if self.dense:
                    here[row[known], self.offsets[i] + code[known]] = True
                    at, row = at[~known], row[~known]
                # The others (without a table: all) are told apart by their code points.
                raw = np.zeros(len(at), np.int64)
                for j in range(n):
                    raw = raw * POINTS + c.flat[at + j]
                row, raw = distinct(row, raw)
                total += np.bincount(row, minlength=k)
                if not self.dense and len(self.codes[i]):
                    place = np.minimum(np.searchsorted(self.codes[i], raw), len(self.codes[i]) - 1)
                    hit = self.codes[i][place] == raw
                    here[row[hit], self.starts[i] + place[hit]] = True
            if self.dense:
                total += here.sum(axis=1)
                here = here[:, self.cells]
            yield first, here, total


def landmark_basis(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """The presence vectors of the texts' first chunks, as normalised columns."""
    c = chunks_of(texts, vocabulary.p)
    first = np.searchsorted(c.owner, np.arange(len(texts)))
    m, total = np.zeros((len(c.owner), len(vocabulary)), np.float32), np.ones(len(c.owner))
    for lo, here, n in vocabulary.presence(c):
        m[lo : lo + len(n)], total[lo : lo + len(n)] = here, n
    return (m[first] / np.sqrt(np.maximum(1, total[first]))[:, None]).T.copy()


def kernel_rows(texts: list[str], vocabulary: Vocabulary, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, weight, (normalised) kernel row against ``basis``, and share of n-grams in the vocabulary, per chunk."""
    c = chunks_of(texts, vocabulary.p)
    out, share = np.zeros((len(c.owner), basis.shape[1]), np.float32), np.zeros(len(c.owner))
    for lo, here, n in vocabulary.presence(c):
        many = np.maximum(1, n)
        out[lo : lo + len(n)] = (here.astype(np.float32) @ basis) / np.sqrt(many)[:, None]
        share[lo : lo + len(n)] = here.sum(axis=1) / many
    return c.owner, c.weight, out, share


def pieces(texts: list[str | None], span: int = 200_000) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in groups of about so many characters, very long ones cut; each piece with the number of its text."""
    at, owners, group = 0, [], []
    for i, t in enumerate(texts):
        for k in range(0, len(t or ""), span):
            owners.append(i)
            group.append(t[k : k + span])
            at += len(group[-1])
            if at >= span:
                yield owners, group
                at, owners, group = 0, [], []
    if group:
        yield owners, group


@dataclass
class LanguageModel:
    params: KernelParams
    languages: list[str]
    vocabulary: Vocabulary | None
    basis: np.ndarray
    weights: np.ndarray  # landmarks + 1 rows: the last is the intercept

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of the distinct n-grams that landmarks hold, of each text."""
        covered, mass = np.zeros(len(texts)), np.zeros(len(texts))
        total = np.zeros((len(texts), max(1, len(self.languages))))
        for owners, group in pieces(texts) if self.languages else ():
            own, weight, k, share = kernel_rows(group, self.vocabulary, self.basis)
            rows = np.array(owners)[own]
            np.add.at(total, rows, (k @ self.weights[:-1] + self.weights[-1]) * weight[:, None])
            np.add.at(mass, rows, weight)
            np.add.at(covered, rows, share * weight)
        best, seen = total.argmax(axis=1), mass > 0
        top = np.where(seen, total[np.arange(len(texts)), best] / np.maximum(mass, 1), 0.0)
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), seen.tolist(), strict=True)], np.clip(top, 0, 1), np.clip(covered / np.maximum(mass, 1), 0, 1)


def training_rows(labelled: DataFrame, p: KernelParams, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``l, t, r``: the whole texts (with a letter) of at most ``per_lang`` rows of each language, ranked by a hash of the id.

    Rows are ranked by their keys alone, first in 16 shares of each language by the hash, of which ``per_lang`` each go on,
    whatever the size of the table; the texts are looked up for the chosen.
    """
    rows = labelled.select(labelled[id_col].cast("string").alias("k"), labelled[text_col].cast("string").alias("t"), labelled[lang_col].cast("string").alias("l"))
    rows = rows.where("l is not null and t is not null").where(F.col("t").rlike(r"\p{L}")).withColumn("th", F.xxhash64("t"))
    keys = rows.select("l", F.coalesce("k", F.lit("")).alias("k"), "th").withColumn("h", F.xxhash64("k"))
    # Repeated rows have the same rank.
    share = F.dense_rank().over(Window.partitionBy("l", F.pmod("h", F.lit(16))).orderBy("h", "k", "th"))
    keys = keys.withColumn("r", share).where(F.col("r") <= p.per_lang).drop("r")
    rank = F.dense_rank().over(Window.partitionBy("l").orderBy("h", "k", "th"))
    chosen = cut(keys.withColumn("r", rank).where(F.col("r") <= p.per_lang).select("l", F.col("k").alias("k2"), F.col("th").alias("th2"), "r").distinct(), "chosen")
    found = rows.withColumn("k", F.coalesce("k", F.lit(""))).withColumnRenamed("l", "l1").join(chosen, (F.col("l1") == F.col("l")) & (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2")))
    return cut(found.select("l", "t", "r").dropDuplicates(["l", "r"]), "training")


def landmark_texts(rows: DataFrame, p: KernelParams) -> dict[str, list[str]]:
    """Of each language, a chunk of each of its first rows: at most ``landmarks`` in all, and as many characters each as a chunk has."""
    spots = F.pmod(F.xxhash64("l", "r"), F.greatest(F.lit(1), F.ceil(F.char_length("t") / p.chunk)))
    chunk = F.substring("t", (spots * p.chunk + 1).cast("int"), F.lit(p.chunk))
    chunk = F.when(chunk.rlike(r"\p{L}"), chunk).otherwise(F.regexp_extract("t", rf"(?s)\p{{L}}.{{0,{p.chunk - 1}}}", 0))
    many = rows.select("l").distinct().count()
    out: dict[str, list[str]] = {}
    for r in rows.where(F.col("r") <= max(1, p.landmarks // max(1, many))).select("l", "r", chunk.alias("c")).orderBy("l", "r").collect():
        out.setdefault(r.l, []).append(r.c)
    return out


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: KernelParams | None = None) -> LanguageModel:
    p = params or KernelParams()
    rows = training_rows(labelled, p, id_col, text_col, lang_col)
    marks = landmark_texts(rows, p)
    languages = sorted(marks)
    if not languages:
        discard(rows)
        return LanguageModel(p, [], None, np.zeros((0, 0), np.float32), np.zeros((1, 0)))
    texts = [t for lang in languages for t in marks[lang]]
    vocabulary = Vocabulary(texts, p)
    basis = landmark_basis(texts, vocabulary)
    values, vectors = np.linalg.eigh((basis.T @ basis).astype(float))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    size = whiten.shape[1] + 1
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, basis, whiten))  # bounded by landmarks and chunk

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per language: the number of chunks, and the sums of their features and of the features' products."""
        vocabulary, basis, whiten = shared.value
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for owners, group in pieces(texts):
                own, _, k, _ = kernel_rows(group, vocabulary, basis)
                phi = np.c_[k.astype(float) @ whiten, np.ones(len(own))]
                rows = np.array([langs[i] for i in owners])[own]
                for lang in set(rows.tolist()):
                    x = phi[rows == lang]
                    total[lang] = total.get(lang, 0) + np.r_[len(x), x.sum(axis=0), (x.T @ x).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["l", "s"])

    gram, target = np.zeros((size, size)), np.zeros((size, len(languages)))
    parts = small_batches(rows).select("l", "t").coalesce(8).mapInArrow(sums, "l string, s binary").collect()  # at most 8 rows a language
    discard(rows)
    for i, lang in enumerate(languages):
        s = np.sum([np.frombuffer(r.s) for r in sorted((r for r in parts if r.l == lang), key=lambda r: r.s)], axis=0)
        gram += s[1 + size :].reshape(size, size) / s[0]  # languages weigh the same
        target[:, i] = s[1 : 1 + size] / s[0]
    penalty = np.diag([p.ridge] * (size - 1) + [0.0])
    w = np.linalg.solve(gram + penalty, target)
    return LanguageModel(p, languages, vocabulary, basis, np.r_[whiten @ w[:-1], w[-1:]])


def least_known(model: LanguageModel, left_out: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The ``known_share`` below which a text is like none of the languages, from labelled rows that taught nothing.

    Two thirds of what all but a twentieth of these rows reach.  Every row counts: shares are counted by hundred-thousandths.
    """
    if not model.languages:
        return 0.0
    rows = left_out.where(F.col(lang_col).isNotNull() & F.col(text_col).cast("string").rlike(r"\p{L}"))
    level = F.floor(F.col("known_share") * 100_000).cast("long").alias("level")
    counts = predict(rows, model, id_col=id_col, text_col=text_col).groupBy(level).agg(F.count("*").alias("n")).orderBy("level").collect()  # 100,001 at most
    if not counts:
        return 0.0
    many = np.cumsum([r.n for r in counts])
    return 2 / 3 * counts[int(np.searchsorted(many, 0.05 * many[-1]))].level / 100_000


def predict(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id by default), ``lang_pred``, ``score`` and ``known_share`` per row, from the text alone.

    ``text_col`` may be a field of a kept struct (``row.text``).
    """
    keep = [id_col] if keep is None else keep
    struct, _, field = text_col.partition(".")
    inside = bool(field) and struct in keep  # then it travels once
    rows = small_batches(df).select(*[df[c] for c in keep], *([] if inside else [df[text_col].cast("string").alias("_text")]))
    kept = rows.schema[: len(keep)]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks and chunk
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, known_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.struct_field(b.column(keep.index(struct)), field) if inside else b.column(len(keep))
            langs, scores, shares = shared.value.scores(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[*b.schema.names[: len(keep)], "lang_pred", "score", "known_share"])

    return rows.mapInArrow(run, out)


def held_out(id_col: Column) -> Column:
    """Whether the row may not be learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
