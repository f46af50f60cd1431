"""Toxicity: maximum-scoring segments over token log-odds.

A token is a lower-cased word without ASCII punctuation, or, for a word that the fit has not seen often, its longest known
beginning of eight to four bytes. Its weight is the log-odds between toxic and clean documents that hold it, under a Dirichlet prior that is flat
plus proportional to the counts of both. A linear scan finds all maximal segments (Ruzzo and Tompa, 1999); their scores become E-values under the
extreme-value law of Karlin and Altschul, whose two parameters come from clean documents. The best segment's and the sum of
all significant segments' evidence go through a logistic calibration.

The fit takes at most ``most`` labelled documents, which bounds the weights that the driver holds; every text is scored whole.
Null and empty texts have no segment; without two classes all scores are the base rate. A row with a null doc_id counts as held
out and is scored like any other; repeated rows are scored each, and teach once; of other columns none is read.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import held_out, sample

_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_PREFIXES = (8, 7, 6, 5, 4)


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_BLANK).split() if text else []


def _tokens(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in _PREFIXES if len(word) > k)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: token, documents by class. A repeated word says no more about its document than one."""
    seen: dict[bytes, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
            for t in {t for w in set(words(text)) for t in _tokens(w)}:
                seen.setdefault(t, [0, 0])[label] += 1
    cols = list(zip(*seen.values(), strict=True)) if seen else [()] * 2
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), *(pa.array(c, pa.int64()) for c in cols)], names=["token", "clean_docs", "toxic_docs"])


@dataclass
class Model:
    """weights: of whole words and of prefixes. heads: the first four bytes of all of them, so that most words need one look-up."""

    weights: dict[bytes, float] = field(default_factory=dict)
    default: float = -0.05
    decay: float = 1.0
    k: float = 0.1
    calibration: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def __post_init__(self):
        self.heads = {w[:4] for w in self.weights}

    def weight(self, word: bytes) -> float:
        if word[:4] not in self.heads:
            return self.default
        get = self.weights.get
        for token in _tokens(word):
            if (found := get(token)) is not None:
                return found
        return self.default

    def scores(self, text: bytes | None) -> list[float]:
        memo: dict[bytes, float] = {}
        heads, default, out = self.heads, self.default, []
        for w in words(text):
            if w[:4] in heads:
                s = memo.get(w)
                if s is None:
                    s = memo[w] = self.weight(w)
                out.append(s)
            else:
                out.append(default)
        return out

    def evidence(self, scores: list[float]) -> tuple[float, float]:
        """Of the best segment, and of all significant ones together: -ln of the E-value, each 0 at least."""
        found = segments(scores)
        if not found:
            return 0.0, 0.0
        base = math.log(max(self.k * len(scores), 1e-9))
        each = [self.decay * s - max(base, 0.0) for _, _, s in found]
        return min(60.0, max(0.0, *each, 0.0)), min(200.0, sum(e for e in each if e > -math.log(0.05)))

    def score(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.calibration
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * evidence[0] + c * math.log1p(evidence[1])))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments (begin, end, score), in linear time."""
    found: list[list] = []  # begin, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = _before(found, j)
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(b, e, after - before) for b, e, before, after, _ in found]


def _before(found: list[list], j: int) -> int:
    """The nearest earlier segment whose sum before is smaller than that of segment j: its stored link."""
    return found[j][4]


def _decay(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * weight)) = 1; the mean weight is negative."""
    value = lambda x: float((shares * np.exp(np.minimum(x * weights, 600))).sum())
    low, high = 0.0, 1e-3
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge-damped Newton steps; evidence never lowers a score."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.5 * w * [0, 1, 1]), -2, 2)
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, prior: float = 50.0, flat: float = 0.5, sure: float = 3.0, slack: float = 0.6, least: float = 2.0, min_docs: int = 4) -> Model:
    """sure, least: the z-score and the log-odds from which a token counts; the z-score gives way by ``slack`` where toxic texts
    are few, the less the more there are (half of it at 100). min_docs: texts that hold it. prior, flat: pseudo-counts of all
    tokens together, and of each. There are at most as many weights as the sample of ``most`` texts has frequent tokens."""
    small_batches(docs.sparkSession)
    train = sample(docs, labels, "toxic", held_out(5, 0), most)
    sure -= slack * 100 / (100 + (train.agg(F.sum("label")).first()[0] or 0))
    tokens = train.mapInArrow(_counts, "token binary, clean_docs long, toxic_docs long")
    tokens = tokens.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("clean_docs", "toxic_docs")])
    whole = F.substring("token", -1, 1) != F.lit(b"*")
    sums = tokens.where(whole).agg(F.sum("clean_docs"), F.sum("toxic_docs")).first()
    n_clean, n_toxic = (float(x or 0) for x in sums)
    if not n_clean or not n_toxic:
        rate = train.agg(F.avg("label")).first()[0]
        rate = min(0.98, max(0.02, 0.1 if rate is None else rate))
        return Model(calibration=(math.log(rate / (1 - rate)), 0.0, 0.0))
    alpha = flat + prior * (F.col("clean_docs") + F.col("toxic_docs")) / (n_clean + n_toxic)
    odds = lambda c, n: F.log((F.col(c) + alpha) / (n + prior))
    ranked = tokens.where(F.col("toxic_docs") + F.col("clean_docs") >= min_docs)
    ranked = ranked.withColumn("weight", odds("toxic_docs", n_toxic) - odds("clean_docs", n_clean))
    ranked = ranked.withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("clean_docs") + alpha) + 1 / (F.col("toxic_docs") + alpha)))
    top = ranked.where((F.col("z") >= sure) & (F.col("weight") >= least)).select("token", "weight").collect()
    weights = {bytes(r.token): float(r.weight) for r in top}
    # words without weight of their own speak a little against toxicity: the mean must be negative
    model = Model(weights, default=-0.1)
    scored = train.mapInArrow(_profile(model), _PROFILE).select("label", "words", "best", "weight", "times").toPandas()
    clean = scored[scored["label"] == 0]
    bag: Counter = Counter()
    for s, c in zip(clean["weight"], clean["times"], strict=True):
        for a, b in zip(s, c, strict=True):
            bag[a] += int(b)
    value, share = np.array(list(bag), float), np.array(list(bag.values()), float)
    mean = float((value * share).sum() / share.sum())
    if mean > -0.05:
        model.default -= mean + 0.05
    model.decay = _decay(np.where(value == -0.1, model.default, value), share / share.sum())
    best, n = clean["best"].to_numpy(float), np.maximum(clean["words"].to_numpy(float), 1)
    hit = best > 0
    # the location of the maxima of clean texts: E(max) = (ln(K n) + 0.5772) / decay
    model.k = float(np.clip(np.exp(np.mean(model.decay * best[hit] - 0.5772 - np.log(n[hit]))) if hit.sum() >= 20 else 1e-3, 1e-6, 1.0))
    final = train.mapInArrow(_profile(model), _PROFILE).select("label", "top", "total").toPandas()
    x = np.column_stack([np.ones(len(final)), final["top"].to_numpy(float), np.log1p(final["total"].to_numpy(float))])
    model.calibration = _logistic(x, final["label"].to_numpy(float))
    return model


_PROFILE = "label int, total double, words long, best double, top double, weight array<double>, times array<long>"


def _profile(model: Model):
    """The evidence of all significant segments, the best segment's score and evidence, and how often each weight occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PROFILE.split(", ")]
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
                scores = model.scores(text)
                top, total = model.evidence(scores)
                best = max((s for _, _, s in segments(scores)), default=0.0)
                bag = Counter(scores)
                rows.append((label, total, len(scores), best, top, list(bag), list(bag.values())))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def passages(docs: DataFrame, model: Model, significance: float = 0.05) -> DataFrame:
    """The significant toxic passages: doc_id, begin and end (word numbers), score, e_value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                scores = model.scores(text)
                for begin, end, s in segments(scores):
                    e = max(1.0, model.k * len(scores)) * math.exp(-model.decay * s)
                    if e < significance:
                        rows.append((doc_id, begin, end, s, e))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "begin", "end", "score", "e_value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, begin long, end long, score double, e_value double")


def scorer(model: Model):
    """A pandas UDF text -> score."""

    @F.pandas_udf("double")
    def toxicity(text):
        import pandas as pd

        return pd.Series([model.score(model.evidence(model.scores(t.encode() if t else None))) for t in text], dtype=float)

    return toxicity


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in their columns."""
    score = scorer(fit(docs, labels, **how))
    return docs.where(score("text") < threshold)


def digest(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    score = scorer(fit(docs, labels, **how))
    scored = docs.select("doc_id", held_out(5, 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
