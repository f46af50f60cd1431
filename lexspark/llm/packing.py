"""Packing: best-fit decreasing over a segment tree indexed by remaining capacity.

A document is its token ids and then id 0. Documents of a full window or more are first cut into full windows; the rest
of each is packed within a shard of about ``shard_rows`` documents. Only ids, lengths and checksums are shuffled.

Defined cases: null and empty texts are the single id 0; a null doc_id stays null; repeated rows are packed one by one.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: A run of one kind of character of this length goes to the library that takes linear time for it.
LONG_RUN = 20_000


class ByteBpe:
    """The ids of byte_bpe_50k.json. tiktoken reads the same vocabulary several times faster; texts that hold the special
    token's string, or a very long word, go to the tokenizers library itself."""

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(public_tokenizers.path(json_name))

    def __call__(self, text: str) -> list[int]:
        if "<|endoftext|>" in text or len(text) > LONG_RUN and max(map(len, text.split(" "))) > LONG_RUN // 4:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) if text else []
                ids.append(0)
                raw = memoryview(np.array(ids, "<u4").tobytes())
                n = len(ids)
                rows += [(doc_id, at, min(size, n - at), zlib.crc32(raw[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Capacities:
    """Open windows by remaining capacity: a segment tree over 0..size counts them, so that the tightest one that still
    holds a piece is found in log2(size) steps."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of ``least`` or more, and that capacity."""
        node = least + self.width
        while not self.count[node]:
            while node & 1:  # a right child: nothing more beside it
                node >>= 1
                if not node:
                    return None
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.width
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces are at most ``size`` long."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = Capacities(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found, n = (n, size), n + 1
        window[i], offset[i] = found[0], size - found[1]
        if found[1] > length:
            tree.put(found[0], found[1] - length)
    return window, offset


def pack(docs: DataFrame, size: int = 1024, shard_rows: int = 32_768) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(size), PIECES), "pieces")
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())  # of a written table: the same at each attempt
    full = pieces.where(F.col("length") == size).select("*", (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size)
    shards = max(1, round(rest.count() / shard_rows))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        window, offset = best_fit_decreasing(pdf["length"].to_numpy(), size)
        return pdf.assign(sequence_id=2 * ((key[0] << 32) | window), offset=offset)

    packed = rest.groupBy(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")).applyInPandas(one, full.schema)
    return full.union(packed).drop("row")
