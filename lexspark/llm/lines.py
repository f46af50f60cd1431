"""Line dedup: range-partitioned line hashes with a secondary sort, streamed once.

Only hashes, ids and positions move; what comes back per document is a compressed bitmap of kept lines.

Defined cases: null or empty text is one empty line; a null doc_id is a document of its own name;
rows that share a doc_id count as one document and each gets its own result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, ascii_lower, packed, plain_id, small_batches, table

_DROP, _OPEN, _MARK = 0, 1, 2
_FOUND = "kind int, h1 long, h2 long, did long, rk long, pos int"


def _texts(docs: DataFrame) -> DataFrame:
    """did, rk (a hash of the text, so that rows with one doc_id stay apart), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(plain_id().alias("did"), F.xxhash64(text).alias("rk"), text.alias("text"))


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    key = F.btrim(ascii_lower(F.col("line")), F.lit(ASCII_SPACE))
    lines = _texts(docs).select("did", "rk", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("did", "rk", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "did", "rk", "pos")


def _stream(mode: str, min_docs: int):
    """A function over one range partition, sorted by h1, h2, did, rk, pos.

    A run is the rows of one hash. Runs inside the partition are decided at once. The first and the last run may go on in
    the neighbouring partitions: what they can't decide alone comes out as _OPEN rows, with a _MARK row that tells the others.
    Held at a time: a batch, and of the running hash the rows of fewer than ``min_docs`` documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None  # the run that goes on
        hot = None  # its hash, once it is known to be dropped
        first = True  # the run is the partition's first

        def out(kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c) for c in cols[:4]), pa.array(cols[4].astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "h1", "h2", "did", "rk", "pos"])

        def decide(cols: list[np.ndarray], open_first: bool, open_last: bool) -> Iterator[pa.RecordBatch]:
            h1, h2, did = cols[0], cols[1], cols[2]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            doc = new.copy()
            doc[1:] |= did[1:] != did[:-1]
            run_of = np.cumsum(new) - 1
            edge = np.zeros(len(starts), bool)
            edge[0] |= open_first
            edge[-1] |= open_last
            if mode == "first":
                yield out(_DROP, [c[~new] for c in cols])
                yield out(_OPEN, [c[starts[edge]] for c in cols])
                return
            many = np.add.reduceat(doc.astype(np.int64), starts) >= min_docs
            yield out(_DROP, [c[many[run_of]] for c in cols])
            yield out(_MARK, [c[starts[edge & many]] for c in cols])
            yield out(_OPEN, [c[(edge & ~many)[run_of]] for c in cols])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(cols[0]):
                continue
            if hot is not None:
                other = np.flatnonzero((cols[0] != hot[0]) | (cols[1] != hot[1]))
                end = other[0] if len(other) else len(cols[0])
                yield out(_DROP, [c[:end] for c in cols])
                cols = [c[end:] for c in cols]
                if not len(cols[0]):
                    continue
                hot, first = None, False
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            begin = change[-1] + 1 if len(change) else 0
            if begin:
                yield from decide([c[:begin] for c in cols], first, False)
                first = False
            carry = [c[begin:] for c in cols]
            docs = len(np.unique(carry[2]))
            if mode == "first" and len(carry[0]) > 1:
                yield out(_DROP, [c[1:] for c in carry])
                carry = [c[:1] for c in carry]
            elif mode == "all" and docs >= min_docs:
                yield out(_MARK, [c[:1] for c in carry])
                yield out(_DROP, carry)
                hot, carry = (carry[0][0], carry[1][0]), None
        if carry is not None:
            yield from decide(carry, True, True)

    return run


def dropped_lines(docs: DataFrame, mode: str = "all", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """did, rk, pos of the lines to drop.

    mode "first": every occurrence of a key but the first, by document and position.
    mode "all": every occurrence of a key that is found in at least ``min_docs`` documents.
    """
    if mode not in ("first", "all"):
        raise ValueError(f"mode is {mode!r}: it must be 'first' or 'all'")
    dealt = _line_hashes(docs, min_chars).repartitionByRange("h1", "h2", "did").sortWithinPartitions("h1", "h2", "did", "rk", "pos")
    found = table(dealt.mapInArrow(_stream(mode, min_docs), _FOUND), "lines")
    edges = found.where(F.col("kind") != _DROP)
    if mode == "first":
        least = edges.groupBy("h1", "h2").agg(F.min(F.struct("did", "rk", "pos")).alias("least"))
        late = edges.join(least, ["h1", "h2"]).where(F.struct("did", "rk", "pos") > F.col("least"))
    else:
        many = edges.groupBy("h1", "h2").agg(F.max("kind").alias("top"), F.count_distinct(F.when(F.col("kind") == _OPEN, F.col("did"))).alias("n"))
        many = many.where((F.col("top") == _MARK) | (F.col("n") >= min_docs)).select("h1", "h2")
        late = edges.where(F.col("kind") == _OPEN).join(many, ["h1", "h2"], "left_semi")
    return found.where(F.col("kind") == _DROP).select("did", "rk", "pos").union(late.select("did", "rk", "pos"))


@F.pandas_udf(T.BinaryType())
def _pack(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n: int, at: np.ndarray | None) -> bytes:
        keep = np.ones(n, np.uint8)
        if at is not None:
            keep[np.asarray(at, np.int64)] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return pd.Series([one(n, at) for n, at in zip(n_lines, dropped, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _keep(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t: str | None, b: bytes | None) -> str | None:
        if t is None or b is None:
            return t
        lines = t.split("\n")
        return "\n".join(compress(lines, np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines)).tolist()))

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def line_bitmaps(docs: DataFrame, mode: str = "all", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document and text: did, rk, n_lines, n_dropped, keep (zlib of a packed bitmap, a bit for each line)."""
    small_batches(docs.sparkSession)
    drops = dropped_lines(docs, mode, min_docs, min_chars).groupBy("did", "rk").agg(F.collect_set("pos").alias("dropped"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    sizes = _texts(docs).select("did", "rk", n_lines.cast("long").alias("n_lines")).distinct()
    joined = sizes.join(drops, ["did", "rk"], "left")
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    n_dropped = F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(n_dropped).cast("long")
    return joined.select("did", "rk", "n_lines", n_dropped.alias("n_dropped"), _pack("n_lines", "dropped").alias("keep"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the bitmaps applied to text (null: empty), plus n_lines and n_dropped. The columns of ``docs`` keep their names."""
    own = docs.columns
    left = packed(docs, plain_id().alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("rk"))
    joined = left.join(bitmaps, ["did", "rk"], "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    some = F.col("n_dropped") > 0
    cut = _keep(F.when(some, text), F.when(some, F.col("keep")))
    kept = joined.withColumn("cut", cut).withColumn("kept", F.when(some, F.col("cut")).otherwise(text))
    return kept.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own], F.col("n_lines").alias("n_lines_"), F.col("n_dropped").alias("n_dropped_"))


def line_dedup(docs: DataFrame, mode: str = "all", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents without the dropped lines, in the columns of ``docs``, with n_lines_ and n_dropped_ beside them."""
    return keep_lines(docs, line_bitmaps(docs, mode, min_docs, min_chars))


def digest(docs: DataFrame, **how) -> DataFrame:
    kept = line_dedup(docs.select("doc_id", "text"), **how)
    return kept.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
