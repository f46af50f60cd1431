"""The prefix trie against a walk over all prefixes."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lexspark.llm import registry, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(paths: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """Every node by its prefix; subtrees are scanned."""
    members: dict[tuple, list[int]] = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k in members}
    kids = {k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k] for k in members}
    out = []
    for k, ids in members.items():
        under = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in ids if len(paths[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(ids), len(k), parent, len(ids), len(kids[k]), sum(not kids[x] for x in under), sum((len(members[x]) - 1) * words[x] for x in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def ordered(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    paths: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            paths.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in paths.items()}


def rebuilt(paths: dict[int, list]) -> dict[int, list]:
    def one(c: int) -> list:
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = zlib.crc32(str(c).encode()) % 4
        return paths.get(base, [])[:h] + paths[c][h:]

    return {c: one(c) for c in paths}


def made(seed: int, n: int = 70) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 130), n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", None]), rng.choice(["a", "a b", "", None, "c \x0b d\te"])))
    return rows + rng.sample(rows, 5) + [(None, 1, "user", "a b")]


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_rebuilt_and_plain_nodes(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("words", F.lit(1))
    paths = ordered(rows)
    assert found(trie.digest(df)) == brute(rebuilt(paths))
    assert found(trie.nodes(trie.turns(df))) == brute(paths)


def test_hot_conversation_first_turn_and_copies(spark):
    """A third of the rows in one conversation, another in copies: ranges cut through both."""
    long = [(7, t, "user", f"w{t} and w{t % 3}") for t in range(400)]
    copies = [(100 + c, t, "user", f"say {t} to me") for c in range(150) for t in range(3)]
    rows = long + copies + [(1000 + c, t, "user", "hello" if not t else f"{c} {t}") for c in range(100) for t in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(trie.nodes(trie.turns(spark.createDataFrame(rows, SCHEMA).repartition(4)))) == brute(ordered(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_listing_in_blocks(spark, monkeypatch):
    """Ends of a node stand in several blocks and partitions, and hash as one list."""
    n = 3 * trie.BLOCK + 5
    df = spark.range(n).selectExpr("id * 3 as conv_id", "1L as turn", "'user' as role", "'a b' as text")
    root, leaf = sorted(trie.nodes(trie.turns(df)).collect(), key=lambda r: r["depth"])
    assert leaf["ends_sha256"] == hashlib.sha256(",".join(str(3 * i) for i in range(n)).encode()).hexdigest()
    assert (root["n_convs"], root["n_leaves"], root["saved_tokens"], leaf["saved_tokens"]) == (n, 1, 2 * (n - 1), 2 * (n - 1))
    assert root["ends_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(trie.digest(none)) == []
    rows = [(20, 0, "user", "x " * 300_000), (21, 0, "user", "x " * 300_000), (40, 0, None, None)]
    assert found(trie.digest(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(ordered(rows)))


def test_sql_agrees_with_the_walk(spark):
    rows = made(9)
    conversations = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    cols = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    con = duckdb.connect()
    con.register("given", conversations)
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM given")
    got = sorted(con.sql(f"SELECT {cols} FROM ({registry.OP11_SQL})").fetchall())
    assert got == brute(rebuilt(ordered(rows)))
