"""Exact top-k by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt to blocks, queries to chunks; a task holds one block and one chunk, sorts each dimension of the block
once, and walks the lists of each query from its best end, with strides that double. It stops as soon as the sum of the
values reached, weighted by the query, can't beat the kth score. The blocks' lists are then merged per query.

Defined cases: vectors that are null, or that hold null or non-finite components, and rows with a null vec_id take no part;
vectors meet only those of the same length; rows with the query's vec_id are never its candidates; repeated rows are
candidates each, but a query that is repeated is asked once. A vec_id with several vectors asks with each of them. Scores are exact while they fit in 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Lists:
    """A block: ids, integer vectors, and for each dimension the rows in ascending order of that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.stop = 0  # rows scored so far, for tests

    def best(self, query_id: int, query: np.ndarray, k: int, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best, ties to smaller ids."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == query_id
        ids, scores, depth = self.ids[:0], self.vectors[:0, :0].sum(axis=1), 0
        while depth < n:
            to = min(n, depth + stride)
            new = np.zeros(n, bool)
            new[self.order[n - to : n - depth, up]] = True
            new[self.order[depth:to, down]] = True
            if to == n or not len(up) + len(down):
                new[:], to = True, n
            rows = np.flatnonzero(new & ~seen)
            seen[rows] = True
            self.stop += len(rows)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.vectors[rows] @ query])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            bound = (self.sorted[n - to, up] * query[up]).sum() + (self.sorted[to - 1, down] * query[down]).sum()
            if len(ids) == k and bound < scores[-1]:  # at equality an unseen row may tie with a smaller id
                break
            depth, stride = to, 2 * stride
        return ids, scores


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            v, q = _matrix(candidates["v"]), _matrix(queries["v"])
            reach = v.shape[1] * float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0))
            if reach < 2**53:  # exact in doubles, whose products are faster
                v, q = v.astype(float), q.astype(float)
            block = Lists(candidates["vec_id"].to_numpy(), v)
            for query_id, mark, query in zip(queries["vec_id"], queries["mark"], q, strict=True):
                ids, scores = block.best(query_id, query, k)
                out += [(query_id, mark, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score"]).astype("int64")

    return run


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: the usable vectors with components floor(scale * x)."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 8192, chunk_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on vec_id."""
    v = integers(vectors, scale).withColumn("dim", F.size("v"))
    n, n_queries = v.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, chunks = max(1, math.ceil(n / block_rows)), max(1, math.ceil((n_queries or 0) / chunk_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    mark = F.xxhash64("vec_id", "v")
    candidates = v.select("dim", "vec_id", "v", F.pmod(mark, F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"))
    queries = v.where(is_query).dropDuplicates(["vec_id", "v"]).select("dim", "vec_id", "v", mark.alias("mark"), F.pmod(mark, F.lit(chunks)).cast("int").alias("chunk"), every(blocks).alias("block"))
    keys = ["dim", "block", "chunk"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(k), "query_id long, mark long, vec_id long, score long")
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
