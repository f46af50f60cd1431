import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexspark.operators import access, evaluate, lifecycle, policy, snippets

NOW = dt.datetime(2024, 3, 15)
COLUMNS = "source_id long, label string, kind string, indexed_at timestamp, last_accessed_at timestamp, access_count long, chunk_count int, code_chunk_count int, content_hash string"


def sources(spark, *rows):
    made = []
    for i, (kind, days, n, chunks, code) in enumerate(rows):
        at = NOW - dt.timedelta(days=days)
        made.append((i, f"l{i}", kind, at, NOW if n else at, n, chunks, code, f"h{i}"))
    return spark.createDataFrame(made, COLUMNS)


def test_tiers(spark):
    df = sources(spark, ("durable", 0, 0, 2, 2), ("durable", 7, 0, 2, 2), ("durable", 40, 0, 2, 0), ("durable", 30, 0, 2, 2), ("durable", 30, 10, 2, 2), ("ephemeral", 2, 0, 1, 0), ("session", 2, 0, 1, 0))
    got = [r.tier for r in lifecycle.classify(df, F.lit(NOW)).orderBy("source_id").collect()]
    assert got == ["hot", "warm", "evictable", "cold", "warm", "stale", "fresh"]


def test_eviction(spark):
    df = sources(spark, ("durable", 40, 0, 1, 0), ("durable", 40, 1, 1, 0), ("ephemeral", 2, 0, 1, 0), ("session", 90, 0, 1, 0), ("durable", 0, 0, 1, 0))
    chunks = spark.createDataFrame([(0, "a"), (4, "x" * 50)], "source_id long, content string")
    found = lifecycle.eviction_candidates(df, chunks, F.lit(NOW), most=10)
    assert {r.source_id: r.eviction_reason for r in found.collect()} == {0: "retention", 2: "ttl_ephemeral", 3: "ttl_session", 4: "oversized"}
    left, pieces = lifecycle.evict(df, chunks, found)
    assert [r.source_id for r in left.collect()] == [1] and pieces.count() == 0


def test_upsert(spark):
    df = sources(spark, ("durable", 1, 3, 1, 0), ("durable", 1, 3, 1, 0), ("durable", 1, 3, 1, 0))
    rows = [("l0", "durable", "h0", 1), ("l1", "session", "h1", 2), ("l2", "durable", "other", 3), ("new", "durable", "a", 4), ("new", "durable", "b", 5), ("bad", "what", "b", 6)]
    plan = lifecycle.upsert_plan(spark.createDataFrame(rows, "label string, kind string, content_hash string, seq long"), df)
    assert {r.label: r.action for r in plan.collect()} == {"l0": "skip", "l1": "rekind", "l2": "replace", "new": "insert"}
    new = {r.label: r for r in lifecycle.apply_upsert(df, plan, F.lit(NOW)).collect()}
    assert new["l1"].kind == "session" and new["l0"].access_count == 3 and new["l2"].source_id == 3 and new["l2"].access_count == 0 and new["new"].content_hash == "b"


def test_smart_truncate(spark):
    cut = lambda x, n: spark.createDataFrame([(x,)], "x string").select(lifecycle.smart_truncate("x", n)).first()[0]
    assert cut("short", 100) == "short"
    lines = "\n".join(f"line{i:02d}" for i in range(20))
    got = cut(lines, 70)
    assert got.startswith("line00\nline01") and got.endswith("line19") and "lines /" in got
    assert cut("y" * 50, 10).startswith("y" * 50)


def test_throttle(spark):
    t = lambda s: NOW + dt.timedelta(seconds=s)
    calls = spark.createDataFrame([("c", t(s)) for s in (10, 20, 61, 70, 130)], "client string, at timestamp")
    got = [(r["count"], r["limit"]) for r in access.throttle(calls, F.lit(NOW)).orderBy("at").collect()]
    assert [c for c, _ in got] == [1, 2, 1, 2, 1]
    many = spark.createDataFrame([("c", t(s)) for s in range(10)], "client string, at timestamp")
    assert [r["limit"] for r in access.throttle(many, F.lit(NOW)).orderBy("at").collect()] == [2, 2, 2, 1, 1, 1, 1, 1, 0, 0]


def test_snippets(spark):
    text = "a" * 1000 + " needle " + "b" * 1000
    cut = lambda q, n: spark.createDataFrame([(text, q)], "c string, q string").select(snippets.snippet("c", "q", n)).first()[0]
    assert cut("needle", 5000) == text
    assert cut("needle", 700) == "…" + text[701:1301] + "…"
    assert cut("absent", 10) == "a" * 10 + "\n…"


def test_metrics(spark):
    cases = spark.createDataFrame([(1, ["x"], "t"), (2, [], "t"), (3, ["y", "z"], "u")], "query_id int, needles array<string>, content_type string")
    results = spark.createDataFrame([(1, 1, "no"), (1, 2, "has x"), (2, 1, "any"), (3, 1, "y")], "query_id int, rank int, content string")
    got = {r.query_id: r for r in evaluate.case_metrics(results, cases).collect()}
    assert (got[1].recall_at_1, got[1].recall_at_3, got[1].mrr) == (0.0, 1.0, 0.5) and got[1].ndcg_at_10 == pytest.approx(0.6309, abs=1e-4)
    assert got[2].false_positive and got[2].context_recall == 1.0
    assert got[3].context_recall == 0.5


def test_compare(spark):
    base = spark.createDataFrame([("t", "mrr", 0.9), ("t", "avg_context_recall", 1.0), ("t", "recall_at_1", 0.5)], "content_type string, metric string, value double")
    target = spark.createDataFrame([("t", "mrr", 0.885), ("t", "avg_context_recall", 0.999), ("t", "recall_at_1", 0.4)], "content_type string, metric string, value double")
    assert {r.metric: r.regression for r in evaluate.compare(base, target).collect()} == {"mrr": False, "avg_context_recall": True, "recall_at_1": True}


def test_split_chain():
    assert policy.split_chain("echo a && echo b || echo c; echo d | cat") == ["echo a", "echo b", "echo c", "echo d", "cat"]
    assert policy.split_chain("echo 'a; b' \"c && d\" `e | f`; g") == ["echo 'a; b' \"c && d\" `e | f`", "g"]
    assert policy.split_chain(r"echo \"a; b") == [r"echo \"a", "b"] and policy.split_chain("a & b") == ["a & b"]


def test_command_policy(spark):
    policies = [{"deny": ["Bash(rm:*)"], "ask": ["Bash(git push:*)"], "allow": ["Bash(git:*)"]}]
    rows = ["git status", "git push x", "ls; rm -rf /", "rmdir x", "rm"]
    got = spark.createDataFrame([(r,) for r in rows], "c string").select("c", policy.command_decision("c", policies).alias("d")).collect()
    assert {r.c: r.d.decision for r in got} == {"git status": "allow", "git push x": "ask", "ls; rm -rf /": "deny", "rmdir x": "ask", "rm": "deny"}


def test_paths_and_hosts(spark):
    assert spark.range(1).select(policy.path_denied(F.lit("a\\b\\.env"), ["**/.env"])).first()[0] == "**/.env"
    hosts = {"10.1.2.3": True, "172.32.0.1": False, "172.31.0.1": True, "[::1]": True, "fe80::1": True, "example.com": False, "8.8.8.8": False}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", policy.private_host("h").alias("p")).collect()
    assert {r.h: r.p for r in got} == hosts


def test_platform_urls(spark):
    urls = ["https://github.com/a/b/pull/7", "https://gitlab.x.org/g/p/-/merge_requests/3", "https://github.com/a/b", "nonsense", "https://gist.github.com/x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(policy.platform_url("u").alias("i"), policy.is_gist("u").alias("g")).collect()
    assert [(r.i.kind, r.i.number) if r.i else None for r in got] == [("pr", "7"), ("mr", "3"), None, None, None] and got[4].g


def test_throttle_folds_many_calls_of_one_client(spark):
    import datetime

    from lexspark.operators import access

    start = datetime.datetime(2024, 1, 1)
    rows = [(k % 2, start + datetime.timedelta(seconds=k * k % 5000)) for k in range(4000)]
    got = {}
    for r in access.throttle(spark.createDataFrame(rows, "client int, at timestamp"), F.lit("2024-01-01").cast("timestamp"), 60).collect():
        got.setdefault(r.client, []).append((r["at"], r["count"], r.limit))
    for client in (0, 1):
        begin, n, expected = start, 0, []
        for at in sorted(a for c, a in rows if c == client):
            if (at - begin).total_seconds() > 60:
                begin, n = at, 0
            n += 1
            expected.append((at, n, 2 if n <= 3 else 1 if n <= 8 else 0))
        assert sorted(got[client]) == sorted(expected)


def test_holders_equal_containment(spark):
    from lexspark.operators import evaluate

    docs = [(1, "say alpha beta gamma delta epsilon zeta now"), (2, "alpha beta gamma"), (3, "xalpha beta gamma delta epsilon zetax"), (4, "one two"), (5, "beta gamma delta epsilon")]
    items = [(10, "alpha beta gamma delta epsilon zeta"), (11, "two"), (12, "alpha beta gamma delta  epsilon zeta")]
    found = evaluate.holders(spark.createDataFrame(docs, "doc_id int, content string"), spark.createDataFrame(items, "query_id int, text string"))
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(q, d) for q, t in items for d, c in docs if t in c}
