"""Quality: histogram gradient-boosted trees over document statistics, flattened into arrays.

The driver fits on at most ``most`` labelled documents (a documented bound: ``most`` rows of some thirty numbers); every text
is scored whole. Null and empty texts have statistics too (all zero). Without two classes all scores are the base rate. A row
with a null doc_id is scored like any other and teaches nothing; repeated rows are scored each, and teach once.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import held_out, sample

STATISTICS = (
    "bytes", "words", "lines", "bytes_per_word", "words_per_line", "upper", "lower", "digit", "space", "high",
    "period", "comma", "bang", "pipe", "hash_percent_amp", "star_dollar", "braces", "other_punctuation",
    "distinct_words", "distinct_pairs", "same_as_next", "top_word", "distinct_lines", "longest_word", "short_words", "long_words",
    "capitalised", "all_caps", "ends_in_symbol", "compression", "byte_entropy",
)


def statistics(text: bytes | None) -> list[float]:
    """In the order of STATISTICS; shares are of bytes, words or lines."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    c = np.bincount(raw, minlength=256)
    n = len(raw)
    words = text.split()
    k = max(1, len(words))
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    of = lambda chars: float(c[np.frombuffer(chars, np.uint8)].sum() / n)
    heads = np.fromiter(map(operator.itemgetter(0), words), np.int64, len(words))
    tails = np.fromiter(map(operator.itemgetter(-1), words), np.int64, len(words))
    share = c[c > 0] / n
    odd = np.isin(tails, np.frombuffer(b"#$%&*!|@~^+=<>", np.uint8))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), n / k, np.log1p(len(words) / len(lines)),
        c[65:91].sum() / n, c[97:123].sum() / n, c[48:58].sum() / n, of(b" \t\r\n"), c[128:].sum() / n,
        of(b"."), of(b","), of(b"!?"), of(b"|"), of(b"#%&"), of(b"*$"), of(b"{}[]<>()"), of(b"@~^+=;:_/\\-'\""),
        len(counts) / k, len(set(zip(words, words[1:], strict=False))) / k, sum(map(operator.eq, words, words[1:])) / k,
        max(counts.values(), default=0) / k, len(set(lines)) / len(lines), np.log1p(sizes.max()), (sizes <= 2).sum() / k, (sizes >= 13).sum() / k,
        ((heads >= 65) & (heads <= 90)).sum() / k, sum(map(bytes.isupper, words)) / k, odd.sum() / k,
        len(zlib.compress(text, 1)) / n, float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class Trees:
    """Boosted trees in arrays: of node i the statistic, the threshold (left if x <= it), the left child (right: the next
    one), and the value; a leaf's left child is itself and its threshold infinite, so that all rows take ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
            out += self.value[at]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500))) if len(x) else np.zeros(0)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss; splits are sought over per-node histograms of binned statistics."""
    rate0 = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    base = float(np.log(rate0 / (1 - rate0)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    codes = np.column_stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)]) if n else np.zeros((0, m), int)
    flat = codes + np.arange(m) * bins  # a histogram of all statistics at once
    raw = np.full(n, base)
    for _ in range(rounds if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), 0.0])
        todo = [(roots[-1], np.arange(n), depth)]
        while todo:
            at, who, left = todo.pop()
            gs, hs = g[who].sum(), h[who].sum()
            nodes[at][3] = rate * gs / (hs + ridge)
            best, cut = 1e-6, None
            if left and len(who) >= 2 * least:
                f = flat[who].ravel()
                hist = [np.bincount(f, np.repeat(v, m), m * bins).reshape(m, bins).cumsum(1) for v in (g[who], h[who], np.ones(len(who)))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(who) - nl < least)] = 0
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > best and b < len(cuts[j]):
                    cut = (int(j), int(b))
            if cut is None:
                raw[who] += nodes[at][3]
                continue
            near = codes[who, cut[0]] <= cut[1]
            child = len(nodes)
            nodes += [[0, np.inf, child, 0.0], [0, np.inf, child + 1, 0.0]]
            nodes[at][:3] = [cut[0], float(cuts[cut[0]][cut[1]]), child]
            todo += [(child, who[near], left - 1), (child + 1, who[~near], left - 1)]
    table = np.array(nodes or np.zeros((0, 4)), float).reshape(-1, 4)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3], np.array(roots, int), depth, base)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [[float(v) for v in statistics(t)] for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, **how) -> Trees:
    small_batches(docs.sparkSession)
    train = sample(docs, labels, "quality", held_out(3, 1), most)
    got = train.mapInArrow(_measured, "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # the same model whatever order the rows come in
    return boost(x[order], got["label"].to_numpy(float)[order], **how)


def scorer(model: Trees):
    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t.encode() if t else None) for t in text], float).reshape(-1, len(STATISTICS))
        return pd.Series(model.scores(x))

    return quality


def digest(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    score = scorer(fit(docs, labels, **how))
    scored = docs.select("doc_id", held_out(3, 1).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
