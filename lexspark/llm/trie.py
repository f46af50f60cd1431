"""Conversation prefix trie: who shares which first turns, and how many words a cache of shared prefixes saves.

A node is a sequence of turns that some conversation begins with. The smallest member owns it; as members only get fewer
along a path, each conversation owns a suffix of its own path. A conversation gives every node on its path the words from
there to its end, less those of nodes that it owns (each node's words count once for all members but one), and a leaf flag
where it owns a leaf. One group-by over prefixes adds these up: no subtree is walked.

Rows may lie unevenly: one conversation, one first turn or one group of copies may hold a third of them. So rows are dealt
by range, running values are worked out within (key, range partition), and carried over from the totals of those, which
number one per key and partition.

Defined cases: rows with a null conv_id take no part; a null turn comes first, equal turns are ordered by role and text;
null role and text are empty; repeated rows are turns of their own; of an empty table there is no node; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, table

WORD = r"[^\x20\x09-\x0D]+"
#: Members that one row of the listing holds.
BLOCK = 1024
_NODE = ("owner", "depth")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, pos (from 1), h1, h2 (128 bits of role and text), words: texts are shuffled once and go no further."""
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where("conv_id is not null")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    hashes = (F.xxhash64(F.lit(n), "role", "text").alias(f"h{n}") for n in (1, 2))
    kept = table(dealt.select("conv_id", F.monotonically_increasing_id().alias("seq"), *hashes, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")
    kept = kept.withColumn("part", F.shiftright("seq", 33).cast("int"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = kept.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("seq"))
    return kept.withColumn("pos", within).join(carried, ["conv_id", "part"]).select("conv_id", "part", (F.col("pos") + F.col("before")).alias("pos"), "h1", "h2", "words")


def conversations_of(turned: DataFrame) -> DataFrame:
    return turned.select("conv_id").distinct()


def rebuilt(turned: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that take the first h turns from the first of their group of ``group`` ids, and their
    own from there on; h is the crc32 of the id, modulo ``most``. Some may have no turn left."""
    first = F.col("conv_id") - F.col("conv_id") % group
    taken = F.when(F.col("conv_id") % group != 0, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).otherwise(F.lit(0))
    heads = turned.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("first"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("head"))
    ids = conversations_of(turned).withColumn("first", first).join(heads, "first", "left")
    # fewer than ``most`` turns a head
    head = F.coalesce("head", F.array().cast(heads.schema["head"].dataType))
    ids = table(ids.select("conv_id", F.slice(head, F.lit(1), taken.cast("int")).alias("head")), "ids")
    spans = turned.select("conv_id", "part").distinct().join(ids.select("conv_id", F.size("head").alias("got")), "conv_id")
    own = turned.join(spans, ["conv_id", "part"]).where(F.col("pos") > taken).withColumn("pos", F.col("pos") - taken + F.col("got"))
    given = ids.select("conv_id", F.lit(-1).alias("part"), F.explode("head").alias("t")).select("conv_id", "part", "t.pos", "t.h1", "t.h2", "t.words")
    return own.select(given.columns).unionByName(given), ids.select("conv_id")


def _paths(turned: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, part, depth, len (of the conversation), k1, k2 (the prefix), rest (words from this turn to the end); depth 0 too.

    A prefix is known by the exclusive or of its turns' hashes with their depths, in 128 bits, so that parts of a
    conversation can be added up."""
    roots = ids.select("conv_id", F.lit(-2).alias("part"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "x1", "x2", "words")])
    tagged = turned.select(
        "conv_id", "part", F.col("pos").cast("long").alias("depth"), F.xxhash64("pos", "h1", "h2").alias("x1"), F.xxhash64("h2", "h1", "pos").alias("x2"), "words"
    )
    rows = roots.unionByName(tagged)
    whole = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = rows.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("words").alias("words"), F.max("depth").alias("last"))
    parts = parts.select(
        "conv_id", "part", F.max("last").over(whole).alias("len"), F.coalesce(F.bit_xor("x1").over(earlier), none).alias("b1"), F.coalesce(F.bit_xor("x2").over(earlier), none).alias("b2"),
        (F.sum("words").over(whole) - F.coalesce(F.sum("words").over(earlier), none)).alias("left"),
    )
    so_far = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    runs = rows.select("conv_id", "part", "depth", "words", F.bit_xor("x1").over(so_far).alias("r1"), F.bit_xor("x2").over(so_far).alias("r2"), F.sum("words").over(so_far).alias("said"))
    rest = (F.col("left") - F.col("said") + F.col("words")).alias("rest")
    return runs.join(parts, ["conv_id", "part"]).select("conv_id", "part", "depth", "len", F.col("r1").bitwiseXOR(F.col("b1")).alias("k1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("k2"), rest)


def _owned(paths: DataFrame) -> DataFrame:
    """With owner (the smallest member of the node) and longest (of its members)."""
    node = ("k1", "k2", "depth")
    dealt = table(paths.repartitionByRange(*node, "conv_id").withColumn("bin", F.spark_partition_id()), "paths")
    every = W.partitionBy(*node)
    bins = dealt.groupBy(*node, "bin").agg(F.min("conv_id").alias("owner"), F.max("len").alias("longest"))
    bins = bins.select(*node, "bin", F.min("owner").over(every).alias("owner"), F.max("longest").over(every).alias("longest"))
    return table(dealt.join(bins, [*node, "bin"]).drop("bin", "k1", "k2"), "owned")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in sorted rows, as rows of at most BLOCK joined ids."""
    for batch in batches:
        owners, depths, ids = (batch.column(i).to_pylist() for i in range(3))
        cuts = [0] + [i for i in range(1, len(ids)) if owners[i] != owners[i - 1] or depths[i] != depths[i - 1]] + [len(ids)]
        begins = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, BLOCK)]
        ends = begins[1:] + [len(ids)]
        made = [[owners[i] for i in begins], [depths[i] for i in begins], [ids[i] for i in begins], [",".join(map(str, ids[i:j])) for i, j in zip(begins, ends, strict=True)]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in made[:3]), pa.array(made[3], pa.string())], names=["owner", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's blocks, which come sorted; one hash is open at a time."""
    now, state = None, None
    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("owner", "depth", "ids")), strict=True):
            if now == (owner, depth):
                state.update(b",")
            else:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (owner, depth), hashlib.sha256()
            state.update(ids.encode())
        yield _digest_rows(done)
    if now:
        yield _digest_rows([(*now, state.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["owner", "depth", "ends_sha256"])


def _ends(owned: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of the nodes where conversations end. A digest is sequential by nature: ids are sorted and
    joined by ranges first, so the task that closes it reads one row for every BLOCK of them, and holds one batch."""
    small_batches(owned.sparkSession)
    last = owned.where("depth = len").select(*_NODE, "conv_id")
    lists = last.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(_blocks, "owner long, depth long, first long, ids string")
    return lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "owner long, depth long, ends_sha256 string")


def nodes(turned: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turned`` is that of :func:`turns`; ``ids`` names the conversations, those without turns too."""
    owned = _owned(_paths(turned, conversations_of(turned) if ids is None else ids))
    mine = F.col("conv_id") == F.col("owner")
    # of a conversation: where its own suffix begins, the words from there on, who owns the node before, does it own a leaf
    parts = owned.groupBy("conv_id", "part").agg(
        F.min(F.when(mine, F.col("depth"))).alias("begin"), F.max(F.when(mine, F.col("rest"))).alias("own_rest"),
        F.max(F.when(~mine, F.struct("depth", "owner"))).alias("above"), F.max((mine & (F.col("depth") == F.col("len")) & (F.col("longest") == F.col("len"))).cast("long")).alias("leaf"),
    )
    every = W.partitionBy("conv_id")
    parts = parts.select(
        "conv_id", "part", F.min("begin").over(every).alias("begin"), F.coalesce(F.max("own_rest").over(every), F.lit(0)).alias("own_rest"),
        F.max("above").over(every)["owner"].alias("above"), F.max("leaf").over(every).alias("leaf"),
    )
    rows = owned.join(parts, ["conv_id", "part"])
    parent = F.when(mine & (F.col("depth") > 0), F.when(F.col("depth") > F.col("begin"), F.col("conv_id")).otherwise(F.col("above")))
    child = F.coalesce((F.col("depth") < F.col("len")) & (F.col("depth") + 1 >= F.col("begin")), F.lit(False))
    found = rows.groupBy(*_NODE).agg(
        F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("rest") - F.col("own_rest"), F.lit(0))).alias("saved_tokens"),
    )
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    return found.join(_ends(owned), list(_NODE), "left").select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def digest(conversations: DataFrame) -> DataFrame:
    """Nodes of the rebuilt conversations."""
    return nodes(*rebuilt(turns(conversations)))
