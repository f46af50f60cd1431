"""The jobs: whole runs, reruns, growing input, odd rows and the command line, on small copies."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, job1_knowledge, job2_archive
from lexspark import store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TURNS = "conv_id long, turn long, role string, text string"


def archive(spark, s) -> dict[str, list]:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{s.out}/{name}")
    return {
        "messages": sorted(map(tuple, job2_archive.current(read("messages", job2_archive.MESSAGES)).drop("bucket").collect())),
        "cards": sorted(map(tuple, read("cards", job2_archive.CARDS).drop("bucket").collect())),
        "rejected": sorted((tuple(r) for r in read("rejected", job2_archive.REJECTED).drop("batch").collect()), key=str),
    }


def put(spark, rows, path):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(str(path))


FIRST = [(1, 0, "user", "hi there"), (1, 1, "assistant", "a" * 150), (2, 0, "system", None), (3, None, "user", "x"), (None, 0, "user", "y"), (4, 0, "robot", "z"), (4, 1, None, "z")]
SECOND = [(1, 1, "assistant", "b" * 150), (1, 2, "assistant", "AKIA" + "ABCDEFGHIJKLMNOP" + " " + "c" * 60), (5, 0, "user", " line one\nline two "), (1, 0, "user", "hi there"), (5, 0, "user", " line one\nline two ")]


def test_archive_takes_what_is_new(spark, tmp_path):
    turns = tmp_path / "turns"
    s = job2_archive.Settings(str(turns), str(tmp_path / "out"), str(tmp_path / "checkpoint"), buckets=4)
    put(spark, FIRST, turns)
    job2_archive.run(spark, s)
    one = archive(spark, s)
    assert [m[:3] for m in one["messages"]] == [(1, 0, "user"), (1, 1, "assistant"), (2, 0, "system")]
    assert {r[:4] for r in one["rejected"]} == {(3, None, "user", "no turn"), (None, 0, "user", "no session"), (4, 0, "robot", "unknown role"), (4, 1, None, "unknown role")}
    card = {c[0]: c for c in one["cards"]}
    assert card[1][1:] == ("hi there", 2, 1, 1, 158, 0, 1, False) and card[2][1] == ""
    files = {f: os.path.getmtime(f) for d, _, fs in os.walk(s.out) for x in fs if (f := os.path.join(d, x)).endswith(".parquet")}
    job2_archive.run(spark, s)
    assert archive(spark, s) == one
    assert {f: os.path.getmtime(f) for d, _, fs in os.walk(s.out) for x in fs if (f := os.path.join(d, x)).endswith(".parquet")} == files, "nothing new: nothing is written"
    put(spark, SECOND, turns)
    job2_archive.run(spark, s)
    two = archive(spark, s)
    assert [m for m in two["messages"] if m[:2] == (1, 1)] == [(1, 1, "assistant", "b" * 150)], "a turn that is sent again is replaced"
    assert "[REDACTED_SECRET]" in [m for m in two["messages"] if m[:2] == (1, 2)][0][3]
    assert {c[0]: c for c in two["cards"]}[5][1] == "line one line two"
    assert {c[0]: c for c in two["cards"]}[1][-1] is True
    # one run over all of it, where each file has come in its own batch, gives the same
    other = job2_archive.Settings(str(turns), str(tmp_path / "out2"), str(tmp_path / "checkpoint2"), buckets=4, files_a_batch=1)
    job2_archive.run(spark, other)
    assert archive(spark, other) == two
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_archive_batch_that_is_tried_again(spark, tmp_path):
    s = job2_archive.Settings("", str(tmp_path / "out"), "", buckets=2)
    for batch_id, rows in enumerate((FIRST, SECOND, SECOND)):
        job2_archive.batch(spark, s, spark.createDataFrame(rows, TURNS), min(batch_id, 1))
    first = archive(spark, s)
    job2_archive.batch(spark, s, spark.createDataFrame(SECOND, TURNS), 1)
    assert archive(spark, s) == first
    assert spark.read.parquet(f"{s.out}/messages").count() == 3 + len(SECOND)


def test_archive_of_copies_grows(spark, tmp_path):
    """The given conversations in three deliveries, the second of which repeats some of the first."""
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = tmp_path / "turns"
    s = job2_archive.Settings(str(turns), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    for part in (given.where("turn < 2"), given.where("turn in (1, 2)"), given.where("turn > 2")):
        part.write.mode("append").parquet(str(turns))
        job2_archive.run(spark, s)
    whole = job2_archive.Settings("/root/testdata/sf0.001/conversations.parquet*", str(tmp_path / "out2"), str(tmp_path / "checkpoint2"))
    job2_archive.run(spark, whole)
    assert archive(spark, s) == archive(spark, whole)


def test_archive_of_nothing(spark, tmp_path):
    put(spark, [], tmp_path / "turns")
    s = job2_archive.Settings(str(tmp_path / "turns"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    job2_archive.run(spark, s)
    assert archive(spark, s) == {"messages": [], "cards": [], "rejected": []}


def knowledge(spark, tmp_path, docs, events, **more):
    spark.createDataFrame(docs, "doc_id long, text string, source string, kind string").write.mode("overwrite").parquet(str(tmp_path / "documents"))
    spark.createDataFrame(events, "user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("overwrite").parquet(str(tmp_path / "events"))
    s = job1_knowledge.Settings(str(tmp_path / "documents"), str(tmp_path / "events"), str(tmp_path / "out"), **more)
    return s, lambda: {k: sorted((tuple(r) for r in v.collect()), key=str) for k, v in job1_knowledge.run(spark, s).items()}


def test_knowledge_base(spark, tmp_path):
    docs = [
        (1, "alpha\nsecret AKIA" + "ABCDEFGHIJKLMNOP", "web9", "k"), (2, "beta", "chat5", "k"), (3, "beta", "web9", "k"), (4, "gamma", "tool1", "k"), (5, None, None, "k"),
        (6, "x" * 500, "web9", "k"), (None, "delta", "web9", "k"), (7, "one", "web9", "k"), (7, "two", "web9", "k"), (7, "two", "web9", "k"), (8, "y" * 120, "web9", "k"),
        (9, "```\ncode\n```", "web9", "k"),
    ]
    events = [(4, "view", "2024-03-14 12:00:00"), (1, "click", "2024-03-01 00:00:00"), (1, "error", "2024-02-01 00:00:00"), (9, "view", "2024-03-10 00:00:00"), (None, "view", "2024-03-01 00:00:00")]
    s, run = knowledge(spark, tmp_path, docs, events, most_bytes=400, most_content=100)
    out = run()
    rejected = {(r[0], r[4]): r[3] for r in out["rejected"]}
    assert rejected[(6, "too large")] == rejected[(None, "no id")] == rejected[(3, "repeated")] == 1
    assert sum(r[3] for r in out["rejected"] if r[0] == 7) == 2 and len(rejected) == 4
    sources = {r[0]: dict(zip(job1_knowledge.run(spark, s)["sources"].columns, r, strict=True)) for r in out["sources"]}
    gone = {r[0]: r[-1] for r in out["evicted"]}
    assert gone == {2: "ttl_session", 5: "retention", 7: "retention", 8: "oversized"}
    assert {i: r["kind"] for i, r in sources.items()} == {1: "durable", 4: "ephemeral", 9: "durable"}
    assert sources[1]["access_count"] == 1 and str(sources[1]["indexed_at"]) == "2024-02-01 00:00:00" and sources[4]["tier"] == "fresh" and sources[9]["code_chunk_count"] == 1
    assert {r[0] for r in out["chunks"]} == set(sources) and "[REDACTED_SECRET]" in [r for r in out["chunks"] if r[0] == 1][0][3]
    assert run() == out
    # a base that has shrunk leaves nothing of the earlier one behind
    _, again = knowledge(spark, tmp_path, docs[:1], events)
    assert {r[0] for r in again()["sources"]} == {1}


def test_texts_of_a_knowledge_base_are_written_once(spark, tmp_path, monkeypatch):
    docs = [(i, f"{i} " + hashlib.sha256(str(i).encode()).hexdigest() * 40, "web9", "k") for i in range(300)]
    s, run = knowledge(spark, tmp_path, [*docs, (300, docs[0][1], "web9", "k")], [(7, "view", "2024-03-14 12:00:00")])
    made, kept = [], store.kept
    monkeypatch.setattr(store, "kept", lambda df, name: made.append(kept(df, name)) or made[-1])
    out = run()
    assert [r[0] for r in out["chunks"]] == [7] and [r[0] for r in out["rejected"]] == [300] and len(out["evicted"]) == 299
    assert sum(bool({"text", "content"} & set(df.columns)) for df in made) == 1


def test_knowledge_base_of_nothing(spark, tmp_path):
    _, run = knowledge(spark, tmp_path, [], [])
    assert run() == {"chunks": [], "sources": [], "evicted": [], "rejected": []}


def test_settings(spark, tmp_path):
    at = tmp_path / "c.json"
    at.write_text(json.dumps({"buckets": 3, "out": "a"}))
    s = common.settings(spark, job2_archive.Settings, str(at), {"turns": "t", "out": "b", "checkpoint": "c"})
    assert (s.buckets, s.out, s.spread) == (3, "b", 2)
    at.write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError, match="bucket"):
        common.settings(spark, job2_archive.Settings, str(at), {})
    for name, kind, given in (("job1_knowledge", job1_knowledge.Settings, ("documents", "events", "out")), ("job2_archive", job2_archive.Settings, ("turns", "out", "checkpoint"))):
        shipped = common.settings(spark, kind, f"file://{ROOT}/jobs/{name}.json", dict.fromkeys(given, "x"))
        assert shipped == kind(*["x"] * 3)


def test_command_line(tmp_path):
    made = tmp_path / "out"
    call = [sys.executable, "-m", "jobs.job2_archive", "--config", f"{ROOT}/jobs/job2_archive.json", "--turns", "/root/testdata/sf0.001/conversations.parquet*", "--out", str(made), "--checkpoint", str(tmp_path / "cp")]
    ran = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=240, check=True)
    assert "wrote" in ran.stderr and any((made / "cards").glob("bucket=*"))


def test_jobs_do_not_need_the_training_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "jobs")):
        for name in filter(lambda n: n.endswith(".py"), names):
            with open(os.path.join(folder, name)) as f:
                text = f.read()
            assert "llm" not in text and "corpus_pipeline" not in text
