"""SimHash near-dedup over vantage-point trees.

Fingerprints are dealt to the leaves of a vantage-point tree, which the driver builds from a bounded sample. A fingerprint
goes home to one leaf and visits those that its ball of the search radius overlaps by the triangle bound, so that each
linked pair meets in exactly one leaf. A leaf gives the stars of its components, never all pairs. Copies of a fingerprint count once.

Defined cases: texts without words have fingerprint zero and are linked like any other; a null doc_id takes part, is never
a component's smallest while others are there, and alone gives a null component; repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, packed, plain_id, real_id, salted, small_batches, table, unpacked
from .graph import components

#: Fingerprints of a leaf, and at most so many sampled ones in the driver (8 MB).
LEAF, SAMPLE = 4096, 2**20
#: Words of the shingles by which near copies are verified; members of candidate groups that a task verifies at once.
SHINGLE, GROUP = 5, 2000
#: Bands of the second candidate search and least hashes in each: two sets of a similarity s meet with 1 - (1 - s^8)^64.
BANDS, ROWS = 64, 8


def _grams(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the runs of ``width`` words; a shorter text is one run."""
    words = text.lower().split() if text else []
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)] if words else []
    return np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.unique(_grams(text, SHINGLE))


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64) | np.uint64(1)


_FLIP, _TIMES, _FOLD = _odd(1, BANDS * ROWS) - np.uint64(1), _odd(2, BANDS * ROWS), _odd(3, BANDS * ROWS).reshape(BANDS, ROWS)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key per band of a set: a wider fingerprint, of which alike sets have whole bands in common however long they are."""
    if not len(hashes):
        return np.array([], np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 128):
        mixed = hashes[at : at + 128, None] ^ _FLIP
        mixed *= _TIMES
        np.minimum(least, mixed.min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    return _folded(_grams(text, width, seed))


def _folded(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _prints(widths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = [pa.array(np.array([fingerprint(t, w) for t in texts], np.uint64).view(np.int64)) for w in widths]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rk"), *made], names=["did", "rk", *(f"f{w}" for w in widths)])

    return run


def fingerprints(docs: DataFrame, *widths: int) -> DataFrame:
    """did, rk (a hash of the text), f<width> (long) of every row."""
    small_batches(docs.sparkSession)
    schema = "did long, rk long, " + ", ".join(f"f{w} long" for w in widths)
    return docs.select(plain_id().alias("did"), _row_key().alias("rk"), "text").mapInArrow(_prints(widths), schema)


def _row_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a border that leave a fair share on each side and few points near the border."""
    best, found = math.inf, None
    for v in points[rng.integers(len(points), size=8)]:
        count = np.bincount(distance(points, v), minlength=65)
        inside = np.cumsum(count)
        for border in range(64):
            if not 0 < inside[border] < len(points):
                continue
            share = inside[border] / len(points)
            near = count[max(0, border - radius + 1) : border + radius + 1].sum() / len(points)
            cost = near + 2 * max(0, abs(share - 0.5) - 0.15)
            if cost < best:
                best, found = cost, (v, border)
    return found


class Tree:
    """Nodes in arrays: vantage point, border, the two children; a leaf has its number in ``left`` and -1 in ``right``."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self._grow(sample, max(2, len(sample) // max(1, leaves)), np.random.default_rng(7))

    def _grow(self, points: np.ndarray, least: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((0, 0, self.leaves, -1))
        cut = _split(points, self.radius, rng) if len(points) > least else None
        if cut is None:
            self.leaves += 1
            return at
        near = distance(points, cut[0]) <= cut[1]
        left = self._grow(points[near], least, rng)
        self.nodes[at] = (int(cut[0]), cut[1], left, self._grow(points[~near], least, rng))
        return at

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indices, whether it is their home). Visitors come from leaves of smaller numbers only: the pair meets once."""
        todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            at, who, home = todo.pop()
            if not len(who):
                continue
            v, border, left, right = self.nodes[at]
            if right < 0:
                yield left, who, home
                continue
            d = distance(points[who], np.uint64(v)).astype(np.int64)
            near = d <= border
            go_left = np.where(home, near, d <= border + self.radius)
            go_right = np.where(home & ~near, True, d > border - self.radius)
            todo.append((left, who[go_left], home[go_left]))
            todo.append((right, who[go_right], (home & ~near)[go_right]))


def _near(points: np.ndarray, point: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
    """Rows (fingerprint, second fingerprint, node) within reach of a point by both fingerprints."""
    hit = distance(points[:, 0], point[0]) <= reach[0]
    if reach[1] < 64 and hit.any():
        hit[hit] = distance(points[hit, 1], point[1]) <= reach[1]
    return hit


def _join(own: np.ndarray, visitors: np.ndarray, reach: tuple[int, int], rng: np.random.Generator, out: list[tuple[int, int]]) -> None:
    """Stars of the components that links to ``own`` make, by a smaller tree or, for few points, by search from point to point."""
    radius = reach[0]
    cut = _split(own[:, 0], radius, rng) if len(own) > LEAF else None
    if cut is not None:
        d, e = distance(own[:, 0], cut[0]).astype(np.int64), distance(visitors[:, 0], cut[0]).astype(np.int64)
        near, over = d <= cut[1], (d <= cut[1]) & (d > cut[1] - radius)
        if min(near.sum(), (~near).sum()) > len(own) // 50:
            _join(own[near], visitors[e <= cut[1] + radius], reach, rng, out)
            _join(own[~near], np.concatenate([visitors[e > cut[1] - radius], own[over]]), reach, rng, out)
            return
    while len(own):
        group, todo = [own[0]], [(own[0], True)]
        own = own[1:]
        while todo:
            point, is_own = todo.pop()
            hit = _near(own, point, reach)
            if hit.any():
                group += list(own[hit])
                todo += [(x, True) for x in own[hit]]
                own = own[~hit]
            if is_own and len(visitors):
                hit = _near(visitors, point, reach)
                if hit.any():
                    group += list(visitors[hit])
                    todo += [(x, False) for x in visitors[hit]]
                    visitors = visitors[~hit]
        if len(group) > 1:
            nodes = np.array([x[2] for x in group], np.uint64).view(np.int64)
            out += [(int(x), int(nodes.min())) for x in nodes if x != nodes.min()]


def links(prints: DataFrame, radius: int = 2, second_radius: int = 64, leaf: int = LEAF) -> DataFrame:
    """Of distinct rows fp, second, node: edges a, b of nodes that connect exactly those within reach of ``radius`` differing
    bits, and of ``second_radius`` bits of the second fingerprint."""
    n = prints.count()
    leaves = max(1, min(n // leaf, SAMPLE // 64))
    size = 64 * leaves
    part = prints.select("fp") if n <= size else prints.select("fp").sample(size / n, 7)
    sample = np.array(sorted(r.fp for r in part.toLocalIterator()), np.int64).view(np.uint64)
    tree = Tree(sample, leaves, radius)
    reach = (radius, second_radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            for at, who, home in tree.route(cols[0].view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), at, np.int32)), *(pa.array(c[who]) for c in cols), pa.array(home)], names=["leaf", "fp", "second", "node", "home"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        rows, home = np.column_stack([pdf[c].to_numpy() for c in ("fp", "second", "node")]).view(np.uint64), pdf["home"].to_numpy()
        rows, first = np.unique(rows, axis=0, return_index=True)
        _join(rows[home[first]], rows[~home[first]], reach, np.random.default_rng(7), out)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    routed = prints.select("fp", "second", "node").mapInArrow(route, "leaf int, fp long, second long, node long, home boolean")
    return routed.groupBy("leaf").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    fp = F.col(f"f{width}")
    prints = table(fingerprints(docs, width).select("did", fp.alias("fp")), "prints")
    groups = table(prints.groupBy("fp").agg(F.min(real_id()).alias("least")), "groups")
    points = groups.select("fp", F.lit(0).cast("long").alias("second"), F.col("fp").alias("node"))
    roots = components(links(points, radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    named = groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    # copies of one fingerprint may be a third of all rows
    return salted(prints, of, "fp", F.col("did")).select(real_id().alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def alike_sets(sets: list[np.ndarray], similarity: float = 0.8) -> np.ndarray:
    """The number of each set's component; sets are linked if their Jaccard similarity is ``similarity`` or more.

    Exact: two such sets share an item among the rarest of each (a prefix in one common order), so only those are compared.
    A set that has been reached is not looked for again, so a large group costs a search for each member, not one for each pair.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    found, ids, count = np.unique(np.concatenate([*sets, np.array([], np.uint64)]), return_inverse=True, return_counts=True)
    rank = np.empty(len(found), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(found))
    owner, starts = np.repeat(np.arange(n), sizes), np.concatenate([[0], np.cumsum(sizes)])
    ids = rank[ids]
    ids = ids[np.lexsort((ids, owner))]
    prefix = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
    early = np.arange(len(ids)) - starts[owner] < prefix[owner]
    order = np.argsort(ids[early], kind="stable")
    items, holders = ids[early][order], owner[early][order]
    at = np.searchsorted(items, np.arange(len(found) + 1))
    root, free, left, built, mark = np.arange(n), np.ones(n, bool), n, n, np.zeros(len(found), bool)
    for i in range(n):
        todo = [i] if free[i] else []
        left -= len(todo)
        free[todo] = False
        while todo and left:
            x = todo.pop()
            if left < built // 2:  # forget those that have been reached
                items, holders, built = items[free[holders]], holders[free[holders]], left
                at = np.searchsorted(items, np.arange(len(found) + 1))
            own = ids[starts[x] : starts[x + 1]]
            near = np.unique(np.concatenate([holders[at[t] : at[t + 1]] for t in own[: prefix[x]]] + [holders[:0]]))
            near = near[free[near] & (sizes[near] >= similarity * len(own) - 1e-9) & (similarity * sizes[near] <= len(own) + 1e-9)]
            if not len(near):
                continue
            ends = np.cumsum(sizes[near])
            begins = ends - sizes[near]
            mark[own] = True
            same = np.add.reduceat(mark[ids[np.arange(ends[-1]) + np.repeat(starts[near] - begins, sizes[near])]], begins, dtype=np.int64)
            mark[own] = False
            hit = near[same >= similarity * (len(own) + sizes[near] - same) - 1e-9]
            root[hit], free[hit] = i, False
            left -= len(hit)
            todo += hit.tolist()
    return root


def _marked(width: int):
    """did, rk, node (a hash of the text's set of shingles), the fingerprints f1, fw, f5 and the bands of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wide = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                grams = _grams(text, SHINGLE)
                own = np.unique(grams)
                node = xxhash.xxh64_intdigest(own.tobytes())
                wide.append(bands(own).view(np.int64))
                rows.append((node, fingerprint(text, 1), fingerprint(text, width), _folded(grams)))
            made = np.array(rows, np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rk"), *(pa.array(made[:, k]) for k in range(4)), pa.array(wide, pa.list_(pa.int64()))], names=["did", "rk", "node", "f1", "fw", "f5", "bands"])

    return run


def banded(nodes: DataFrame) -> DataFrame:
    """Of distinct rows node, bands: edges a, b that connect the nodes with a band in common."""
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").drop("most")
    return keys.join(shared, ["band", "key"]).where("node != b").select(F.col("node").alias("a"), "b").distinct()


def verified(docs: DataFrame, prints: DataFrame, groups: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Candidate groups (node a, its group b) -> node, root: the components that links of ``similarity`` or more over
    the shingles' sets make in them. One text of each node is read again, so that only texts with candidates travel."""
    members = groups.union(groups.select("b", "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("group"))
    firsts = table(prints.join(members, "node").groupBy("node", "group").agg(F.min(F.struct("did", "rk")).alias("first")).select("node", "group", "first.*"), "firsts")
    parts = max(1, firsts.count() // GROUP)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        root = alike_sets([shingles(t) for t in pdf["text"]], similarity)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "root": nodes[root]})

    texts = docs.select(plain_id().alias("did"), _row_key().alias("rk"), F.col("text").cast("binary").alias("text"))
    held = texts.join(firsts, ["did", "rk"]).select(F.pmod(F.xxhash64("group"), F.lit(parts)).alias("part"), "node", "text")
    return held.groupBy("part").applyInPandas(settle, "node long, root long")


def representatives(docs: DataFrame, radius: int = 2, width: int = 3, words_radius: int = 3, shingle_radius: int = 11, similarity: float = 0.8) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (null ids last, then by the text's hash), in the columns of ``docs``.

    Near copies have a Jaccard similarity of ``similarity`` or more over their sets of five-word shingles; groups are the
    components of such links and nothing else. Fingerprints only find candidates: texts linked as in :func:`near_duplicates`;
    those whose fingerprints over single words differ in at most ``words_radius`` bits and those over five-word shingles in
    at most ``shingle_radius``; and those with one of the :func:`bands` in common, which misses a pair of 0.8 once in
    100,000 whatever its length. Each group of candidates is then verified on its texts.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(plain_id().alias("did"), _row_key().alias("rk"), "text")
    prints = table(keyed.mapInArrow(_marked(width), "did long, rk long, node long, f1 long, fw long, f5 long, bands array<long>"), "prints")
    nodes = table(prints.select("f1", "fw", "f5", "node").distinct(), "nodes")
    zero = F.lit(0).cast("long").alias("second")
    close = links(nodes.select(F.col("fw").alias("fp"), zero, "node"), radius)
    alike = links(nodes.select(F.col("f1").alias("fp"), F.col("f5").alias("second"), "node"), words_radius, shingle_radius, 4 * LEAF)
    wide = banded(prints.select("node", "bands").dropDuplicates(["node"]))
    roots = table(verified(docs, prints, components(close.union(alike).union(wide)), similarity), "roots")
    first = F.min(F.struct((F.col("did") == NO_ID).alias("none"), "did", "rk")).alias("first")
    named = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(first).select("first.did", "first.rk")
    keyed = packed(docs, plain_id().alias("did"), _row_key().alias("rk"))
    return unpacked(keyed.join(kept, ["did", "rk"], "left_semi").dropDuplicates(["did", "rk"]), docs.columns)
