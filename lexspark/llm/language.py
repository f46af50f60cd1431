"""Language ID by hyperdimensional profiles.

Each letter has a random vector of ``dim`` signs, drawn from its code point. A trigram's vector binds those of its letters,
permuted by their place (a cyclic shift by two, one and none) and multiplied; runs of anything but letters are one blank.
A text bundles the vectors of its trigrams, a language those of its documents; a text has the language whose bundle is
nearest by cosine.

The profiles are learned from every labelled document: bundles are sums, so tasks add up their own and Spark adds theirs.
Texts are read whole, long ones in pieces.

Defined cases: a null text, or one without a letter, is "und" with score 0, and so is every text if no language is known;
a text equally near to two languages has the first by name; null languages teach nothing; documents with a null doc_id
count as held out; repeated rows count each; extra columns are ignored; bytes that are no UTF-8 are no letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import held_out

DIM = 1024
UNKNOWN = "und"
#: Characters of a piece, trigrams of a block, and vectors that a task keeps.
PIECE, GRAMS, KEPT = 2**20, 8192, 16384
#: Languages that profiles may hold: with more, the column holds something else.
MOST_LANGUAGES = 10_000
_BLANK, _SHIFT, _LOW = 32, 21, 2**21 - 1


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """Rows of ``dim`` random signs (int8), the same for a code point everywhere: a mixed counter (splitmix64)."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(dim // 64) + np.arange(dim // 64, dtype=np.uint64) + np.uint64(1)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of trigrams, each three code points of 21 bits."""
    a, b, c = (letter_vectors((grams >> (_SHIFT * n)) & _LOW, dim) for n in (2, 1, 0))
    return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c


@dataclass
class _Vectors:
    """Trigrams' vectors; those met last are kept, at most KEPT of them."""

    dim: int
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray | None = None

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Of sorted, distinct trigrams, at most GRAMS of them."""
        new = grams[~np.isin(grams, self.grams, assume_unique=True)]
        if len(new):
            if self.rows is None or len(self.grams) + len(new) > KEPT:
                self.grams, self.rows, new = self.grams[:0], np.zeros((0, self.dim), np.float32), grams
            every = np.concatenate([self.grams, new])
            order = np.argsort(every)
            self.grams, self.rows = every[order], np.concatenate([self.rows, gram_vectors(new, self.dim).astype(np.float32)])[order]
        return self.rows[np.searchsorted(self.grams, grams)]


def _pieces(text: bytes | None) -> Iterator[np.ndarray]:
    """The trigrams of a text, with repeats, piece by piece; none of a text without letters."""
    words = (text or b"").decode("utf-8", "replace")
    tail, any_letter = np.array([_BLANK], np.int64), False
    held: list[np.ndarray] = []
    for at in range(0, len(words), PIECE):
        codes = np.frombuffer(words[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kinds, which = np.unique(codes, return_inverse=True)
        letter = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))
        any_letter |= bool(letter.any())
        codes = np.concatenate([tail, np.where(letter[which], codes, _BLANK)])
        if at + PIECE >= len(words):
            codes = np.append(codes, _BLANK)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
        codes = codes[keep]
        tail = codes[-2:]
        if len(codes) > 2:
            held.append((codes[:-2] << (2 * _SHIFT)) | (codes[1:-1] << _SHIFT) | codes[2:])
        if any_letter:
            yield from held
            held = []


def _bundles(texts: Iterable[bytes | None], vectors: _Vectors) -> Iterator[tuple[int, np.ndarray]]:
    """Place of a text and a bundle of some of its trigrams; a long text comes in parts, one without letters not at all."""
    places: list[int] = []
    grams: list[np.ndarray] = []
    size = 0
    for place, text in enumerate(texts):
        for piece in _pieces(text):
            places.append(place)
            grams.append(piece)
            size += len(piece)
            if size >= PIECE or len(grams) >= 128:
                yield from zip(places, _bundled(grams, vectors), strict=True)
                places, grams, size = [], [], 0
    if grams:
        yield from zip(places, _bundled(grams, vectors), strict=True)


def _bundled(grams: list[np.ndarray], vectors: _Vectors) -> np.ndarray:
    """One bundle for each array of trigrams."""
    kinds, which = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    out = np.zeros((len(grams), vectors.dim))
    for at in range(0, len(kinds), GRAMS):
        n = min(GRAMS, len(kinds) - at)
        here = (which >= at) & (which < at + n) if len(kinds) > GRAMS else slice(None)
        counts = np.bincount(row[here] * n + which[here] - at, minlength=len(grams) * n).reshape(len(grams), n)
        out += counts.astype(np.float32) @ vectors.of(kinds[at : at + n])
    return out


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    #: One unit vector a language.
    vectors: np.ndarray


def _learner(dim: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = _Vectors(dim), {}

        def out() -> pa.RecordBatch:
            made = [pa.array(list(sums), pa.string()), pa.array([list(map(float, v)) for v in sums.values()], pa.list_(pa.float64()))]
            sums.clear()
            return pa.RecordBatch.from_arrays(made, names=["lang", "bundle"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for place, bundle in _bundles(batch.column(1).to_pylist(), vectors):
                lang = langs[place]
                sums[lang] = sums[lang] + bundle if lang in sums else bundle
            if len(sums) > 256:
                yield out()
        yield out()

    return learn


def learned(docs: DataFrame, dim: int = DIM) -> Profiles:
    """Profiles of the languages of ``docs``: lang, text."""
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null").select("lang", F.col("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_learner(dim), "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("at", "x"))
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("bundle"))
    found = sums.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"lang has over {MOST_LANGUAGES} values")
    bundles = np.array([r["bundle"] for r in found], np.float64).reshape(len(found), dim)
    return Profiles(tuple(r["lang"] for r in found), bundles / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12))


def _judge(profiles: Profiles, dim: int):
    languages, unit = profiles.languages, profiles.vectors

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(dim)
        for batch in batches:
            whole = np.zeros((batch.num_rows, dim))
            seen = np.zeros(batch.num_rows, bool)
            for place, bundle in _bundles(batch.column(batch.num_columns - 1).to_pylist(), vectors) if languages else ():
                whole[place] += bundle
                seen[place] = True
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if languages:
                near = whole @ unit.T / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
                best = near.argmax(1)
                pred = [languages[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)]
                score = np.where(seen, np.clip(near[np.arange(len(best)), best], 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return judge


def predict(docs: DataFrame, profiles: Profiles, *keys: Column, dim: int = DIM) -> DataFrame:
    """``keys`` of ``docs`` (its doc_id, if none), lang_pred, score (the cosine, 0 where it is below)."""
    small_batches(docs.sparkSession, 1000)
    rows = docs.select(*(keys or (F.col("doc_id"),)), F.col("text").cast("binary").alias("text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_judge(profiles, dim), f"{kinds}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    out = held_out(5, 0)
    return predict(docs, learned(docs.where(~out)), F.col("doc_id"), out.alias("held_out"))
