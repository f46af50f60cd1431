"""Substring dedup by level-wise doubling.

The lengths double from a short one to the window: 7, 13, 25 and 50 words. At the first level one run in each full window is
enough: the smallest hash among those inside it, so two documents that share a full window share that anchor. Only runs that
are found in two or more different texts are extended to the next length, once to the left and once to the right: whichever
full window holds a run holds one of its extensions too. Levels go on while candidates survive. At the last one only the full
windows around what survived are hashed, with 128 bits, and of each window all documents but the one with the smallest doc_id
lose its words.

Before each shuffle a task settles what its own rows show (a run that it has seen in two documents), so a run that a third
of all documents share sends a row or two per task. Whole copies of a text are represented by the smallest doc_id.

Defined cases: null text has no words; a null doc_id counts as smaller than any other; rows with one doc_id and text get
one and the same result; rows with one doc_id and different texts do not take words from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_id, real_id, salted, small_batches, table

_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB53)
#: Rows that a task settles at a time.
CHUNK = 1_000_000

Columns = list[np.ndarray]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def rolling(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` word hashes."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=sums[1:])
    return _mix((sums[length:] - sums[:-length]) * _powers(pow(base, -1, 2**64), n))


def _slide(values: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """ufunc over every ``width`` values in a row, in log2(width) passes."""
    done, span = values, 1
    while 2 * span <= width:
        done, span = ufunc(done[:-span], done[span:]), 2 * span
    return ufunc(done[: len(values) - width + 1], done[width - span :]) if span < width else done


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row, and where each text's begin."""
    split = [t.split() if t else [] for t in texts]
    at = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(w) for w in split], out=at[1:])
    return np.fromiter((xxhash.xxh64_intdigest(w) for words in split for w in words), np.uint64, int(at[-1])), at


def _inside(at: np.ndarray, length: int) -> np.ndarray:
    """Of every position, whether a run of ``length`` that starts there ends in the same text."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    return left >= length


def anchors(words: np.ndarray, at: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of runs of ``length``: in each run of ``window`` words, those with the smallest hash."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(words, length, _BASES[0])
    inner = window - length + 1
    least = np.where(_inside(at, window)[: len(words) - window + 1], _slide(h, inner, np.minimum), 0)
    edge = np.zeros(inner - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), inner, np.maximum)
    pos = np.flatnonzero((h == most) & (most > 0))
    return pos, h[pos]


def _new(cols: Columns) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = False
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _take(cols: Columns, by: np.ndarray) -> Columns:
    return [c[by] for c in cols]


def _batch(schema: str, cols: Columns) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if k == "int" else np.int64)) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _chunks(parts: Iterator[Columns]) -> Iterator[Columns]:
    held: list[Columns] = []
    n = 0
    for cols in parts:
        held.append(cols)
        n += len(cols[0])
        if n >= CHUNK:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


# -- a level's windows, by text: which are found in two different texts? ------------------------------------------------

_WINDOWS = "h long, dh long, pos int, known int"


def _settle_texts(cols: Columns) -> Columns:
    """h, dh, pos -> those and known: 1 if this task alone shows two texts. The first row of two texts stays open, to tell others."""
    cols = _take(cols, np.lexsort((cols[2], cols[1], cols[0])))
    cols = _take(cols, _new(cols))  # copies of a text in this task
    run, text = _new(cols[:1]), _new(cols[:2])
    run_of = np.cumsum(run) - 1
    texts = np.add.reduceat(text.astype(np.int64), np.flatnonzero(run)) if len(run) else np.zeros(0, np.int64)
    text_no = np.cumsum(text)
    nth = text_no - text_no[np.flatnonzero(run)][run_of] if len(run) else text_no
    known = (texts[run_of] > 1) & ~(text & (nth < 2))
    return [*cols, known.astype(np.int32)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of _WINDOWS sorted by known, h, dh: the dh and pos of windows in two texts."""
    carry: Columns | None = None
    hot = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        known = cols[3] == 1
        if known.any():
            yield _batch("dh long, pos int", _take(cols[1:3], known))
        cols = _take(cols[:3], ~known)
        if hot is not None and len(cols[0]):
            other = np.flatnonzero(cols[0] != hot)
            end = other[0] if len(other) else len(cols[0])
            yield _batch("dh long, pos int", [c[:end] for c in cols[1:]])
            cols = [c[end:] for c in cols]
            hot = hot if not len(cols[0]) else None
        if not len(cols[0]):
            continue
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        run = _new(cols[:1])
        starts = np.flatnonzero(run)
        ends = np.append(starts[1:], len(run)) - 1
        many = (cols[1][starts] != cols[1][ends])[np.cumsum(run) - 1]
        yield _batch("dh long, pos int", _take(cols[1:], many))
        carry = None
        if many[-1]:
            hot = cols[0][-1]
        else:
            carry = [c[starts[-1] :] for c in cols]


def _in_two_texts(windows: DataFrame) -> DataFrame:
    """dh and the set of positions of the windows that two texts or more share."""
    key = F.when(F.col("known") == 1, F.xxhash64("dh", "pos")).otherwise(F.col("h"))
    dealt = windows.repartition(key).sortWithinPartitions("known", "h", "dh")
    return dealt.mapInArrow(_shared, "dh long, pos int").groupBy("dh").agg(F.collect_set("pos").alias("at"))


def _level(find: Callable[[pa.RecordBatch], Columns]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _chunks(find(b) for b in batches):
            yield _batch(_WINDOWS, _settle_texts(cols))

    return run


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _find_anchors(length: int, window: int):
    def find(batch: pa.RecordBatch) -> Columns:
        words, at = word_hashes(_bytes(batch, "text"))
        pos, h = anchors(words, at, length, window)
        doc = np.searchsorted(at, pos, "right") - 1
        return [h.view(np.int64), batch.column("dh").to_numpy()[doc], pos - at[doc]]

    return find


def _around(batch: pa.RecordBatch, at: np.ndarray, had: int, length: int) -> np.ndarray:
    """Positions where a run of ``length`` starts that holds one of the runs of ``had`` words that ``at`` lists."""
    spread = length - had
    turn = np.zeros(at[-1] + spread + 2, np.int64)
    flat, doc = _listed(batch, at)
    np.add.at(turn, np.maximum(flat - spread, 0) + at[doc], 1)
    np.add.at(turn, flat + 1 + at[doc], -1)
    return np.flatnonzero((np.cumsum(turn)[: at[-1]] > 0) & _inside(at, length))


def _listed(batch: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that the lists ``at`` hold, counted from the batch's first word, and the row of each."""
    lists = batch.column("at")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return flat, doc


def _find_longer(had: int, length: int):
    """The two extensions of each run: to the right, and to the left."""

    def find(batch: pa.RecordBatch) -> Columns:
        words, at = word_hashes(_bytes(batch, "text"))
        flat, doc = _listed(batch, at)
        start, doc = np.concatenate([flat, flat - (length - had)]), np.concatenate([doc, doc])
        fits = (start >= 0) & (start + length <= np.diff(at)[doc])
        pos, first = np.unique((start + at[doc])[fits], return_index=True)
        doc = doc[fits][first]
        return [rolling(words, length, _BASES[0])[pos].view(np.int64), batch.column("dh").to_numpy()[doc], pos - at[doc]]

    return find


# -- the last level: which windows does a smaller doc_id have? ----------------------------------------------------------

_LAST = "h1 long, h2 long, did long, dh long, start int, n int, known int"


def _runs(cols: Columns, same: int, window: int) -> tuple[Columns, np.ndarray]:
    """Rows with the first ``same`` columns in common whose starts (the last column) are at most a window apart cover one
    stretch of words: the first of them, and from its start to the last one's, how many starts."""
    new = _new(cols[:same])
    new[1:] |= cols[-1][1:] > cols[-1][:-1] + window
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    return _take(cols, first), cols[-1][last] - cols[-1][first] + 1 if len(first) else np.zeros(0, np.int64)


def _settle_docs(cols: Columns, window: int) -> Columns:
    """h1, h2, did, dh, start -> _LAST: of each window here the smallest did, open, and known runs of the others. A text that
    repeats a few words without end has one window at many starts: one row."""
    cols = _take(cols, np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0])))
    run = _new(cols[:2])
    later = cols[2] != cols[2][np.flatnonzero(run)][np.cumsum(run) - 1]
    left, n_left = _runs(_take(cols, ~later), 4, window)
    known = _take(cols[2:], later)
    known, n_known = _runs(_take(known, np.lexsort((known[2], known[1], known[0]))), 2, window)
    none, blank = np.zeros(len(n_left), np.int32), np.zeros(len(n_known), np.int64)
    return [np.concatenate(x) for x in zip([*left, n_left, none], [blank, blank, *known, n_known, np.ones(len(n_known), np.int32)], strict=True)]


def _windows(had: int, window: int):
    def find(batch: pa.RecordBatch) -> Columns:
        words, at = word_hashes(_bytes(batch, "text"))
        pos = _around(batch, at, had, window)
        doc = np.searchsorted(at, pos, "right") - 1
        h1, h2 = (rolling(words, window, b)[pos].view(np.int64) for b in _BASES)
        return [h1, h2, batch.column("did").to_numpy()[doc], batch.column("dh").to_numpy()[doc], pos - at[doc]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _chunks(find(b) for b in batches):
            yield _batch(_LAST, _settle_docs(cols, window))

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of _LAST sorted by known, h1, h2, did: the runs of starts that some smaller did has too."""
    last: tuple | None = None  # h1, h2 and smallest did of the window that goes on
    out = "did long, dh long, start int, n int"
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        known = cols[6] == 1
        if known.any():
            yield _batch(out, _take(cols[2:6], known))
        cols = _take(cols, ~known)
        if not len(cols[0]):
            continue
        run = _new(cols[:2])
        least = cols[2][np.flatnonzero(run)]
        if last is not None and (cols[0][0], cols[1][0]) == last[:2]:
            least[0] = last[2]
        least = least[np.cumsum(run) - 1]
        yield _batch(out, _take(cols[2:6], cols[2] != least))
        last = (cols[0][-1], cols[1][-1], least[-1])


def _hex(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _cover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, at in zip(_bytes(batch, "text"), batch.column("at").to_pylist(), strict=True):
                words = text.split() if text else []
                turn = np.zeros(len(words) + 1, np.int64)
                if at:
                    start = np.array([x["start"] for x in at])
                    np.add.at(turn, start, 1)
                    np.add.at(turn, start + np.array([x["n"] for x in at]) + window - 1, -1)
                gone = np.cumsum(turn)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((int(gone.sum()), b" ".join(kept).decode()))
            n, kept = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("dh"), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["did", "dh", "n_removed", "kept"])

    return run


@F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
def _whole(text: pd.Series) -> pd.DataFrame:
    split = [t.encode().split() if t else [] for t in text]
    return pd.DataFrame({"n_words": [len(w) for w in split], "kept_sha256": [_hex(w) for w in split]})


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(plain_id().alias("did"), F.xxhash64(text).alias("dh"), text.alias("text"))


def lengths(window: int, shortest: int) -> list[int]:
    """The window halved (upwards) until a length is ``shortest`` or less, in ascending order: two at least."""
    found = [window]
    while found[0] > shortest or len(found) < 2:
        found.insert(0, -(-found[0] // 2))
    return found


def repeated(docs: DataFrame, window: int = 50, shortest: int = 7) -> tuple[DataFrame, DataFrame]:
    """(texts, cut). texts: dh and the smallest did of texts that stand in several rows. cut: did, dh, n_removed, kept of texts that lose words."""
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    sizes = lengths(window, shortest)
    firsts = texts.groupBy("dh").agg(F.min("did").alias("did"), F.count("*").alias("n"))
    at = _in_two_texts(texts.select("dh", "text").mapInArrow(_level(_find_anchors(sizes[0], window)), _WINDOWS)).join(firsts.drop("n"), "dh")
    # the only texts that are written: one of each that holds a candidate
    held = table(texts.join(at, ["did", "dh"]).dropDuplicates(["did", "dh"]), "repeats")
    left, had, at = held, sizes[0], held
    for length in sizes[1:-1]:
        if at.isEmpty():
            break
        at = table(_in_two_texts(left.select("dh", "text", "at").mapInArrow(_level(_find_longer(had, length)), _WINDOWS)), "survivors")
        left, had = held.drop("at").join(at, "dh"), length
    last = left.select("did", "dh", "text", "at").mapInArrow(_windows(had, window), _LAST)
    key = F.when(F.col("known") == 1, F.xxhash64("did", "start")).otherwise(F.col("h1"))
    later = last.repartition(key).sortWithinPartitions("known", "h1", "h2", "did").mapInArrow(_later, "did long, dh long, start int, n int")
    spans = later.groupBy("did", "dh").agg(F.collect_list(F.struct("start", "n")).alias("at"))
    joined = held.drop("at").join(spans, ["did", "dh"])
    return firsts.where("n > 1").drop("n"), joined.mapInArrow(_cover(window), "did long, dh long, n_removed long, kept string")


def digest(docs: DataFrame, window: int = 50, shortest: int = 7) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    firsts, cut = repeated(docs, window, shortest)
    cut = cut.select("did", "dh", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
    whole = _texts(docs).select("did", "dh", _whole("text").alias("w")).select("did", "dh", "w.*")
    # copies of one text may be a third of all rows
    both = salted(whole, firsts.withColumnRenamed("did", "first"), "dh", F.col("did"), how="left").join(cut, ["did", "dh"], "left")
    copy = (F.col("did") != F.col("first")) & (F.col("n_words") >= window)
    empty = hashlib.sha256(b"").hexdigest()
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(copy, F.lit(empty)).otherwise(F.coalesce("sha", "kept_sha256"))
    return both.select(real_id().alias("doc_id"), "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256"))
