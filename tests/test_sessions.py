import json

import pytest
from pyspark.sql import functions as F

from lexspark.operators import sessions, vault
from lexspark.sources import files, pages


def lines(spark, *objects):
    return spark.createDataFrame([("s", i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)], "session string, line_no int, line string")


def user(text, **more):
    return {"type": "user", "uuid": "u", "timestamp": "2024-01-02T03:04:05.123Z", "message": {"role": "user", "content": text}} | more


def assistant(msg, *blocks):
    return {"type": "assistant", "uuid": msg, "message": {"id": msg, "role": "assistant", "content": list(blocks)}}


TEXT = lambda t: {"type": "text", "text": t}
TOOL = lambda name, **i: {"type": "tool_use", "name": name, "id": name, "input": i}


def pairs(spark, *objects):
    got = sessions.turn_pairs(sessions.messages(sessions.parse_lines(lines(spark, *objects))))
    return [(r.human, r.assistant, r.tools, r.tool_lines) for r in got.orderBy("pair_no").collect()]


def test_pairs_snapshots_and_tools(spark):
    got = pairs(
        spark, "not json", assistant("m0", TEXT("dropped")), user("hello <system-reminder>x</system-reminder>"), assistant("m1", TEXT("one")),
        assistant("m1", TEXT("one"), TOOL("Read", file_path="/f")), assistant("m2", TEXT("two"), TOOL("Other"), TOOL("mcp__pal__chat", prompt="asked")),
        user([{"type": "tool_result", "content": "r"}]), user([TEXT("next")]), assistant("m3", TOOL("Grep")), {"type": "system", "subtype": "away_summary", "content": " gone "},
        assistant("m4", TEXT("lost")), user("last"), {"message": {"role": "assistant", "id": "m5", "content": [TEXT("typed by role")]}},
    )
    assert got == [("hello", "one\ntwo\nasked", ["Read", "mcp__pal__chat"], ["[Read: /f]"]), ("", "gone", [], []), ("last", "typed by role", [], [])]


def test_transcript_and_windows(spark):
    rows = [("s", i, f"q{i}", "a" * 20, ["Read"] if i == 1 else [], ["[Read: x]"] if i == 1 else []) for i in range(8)]
    df = spark.createDataFrame(rows, "session string, pair_no int, human string, assistant string, tools array<string>, tool_lines array<string>")
    rendered = sessions.render_pairs(df)
    assert sessions.transcripts(rendered).first().transcript.startswith("Human: q0\nAssistant: aaaaaaaaaaaaaaaaaaaa\n\nHuman: q1")
    starts = spark.createDataFrame([("s", "2024-01-02 03:04:05")], "session string, t string").select("session", F.to_timestamp("t").alias("start_time"))
    titles = [r.title for r in sessions.windows(rendered, starts, most=200).orderBy("chunk_no").collect()]
    assert titles == ["Session 2024-01-02T03:04:05Z | Turns 1-4 | Tools: Read", "Session 2024-01-02T03:04:05Z | Turns 4-7", "Session 2024-01-02T03:04:05Z | Turns 7-8"]
    assert sessions.windows(rendered, starts, most=10_000).count() == 1
    gate = sessions.indexable(df).first()
    assert gate.pairs == 8 and gate.indexable is False


def test_vault_messages(spark):
    parsed = sessions.parse_lines(
        lines(
            spark, {"type": "ai-title", "aiTitle": "old"}, {"type": "ai-title", "aiTitle": "new"}, user("hi", cwd="/w", gitBranch="b"), assistant("m", TEXT("yes"), TOOL("Bash", command="ls"), TOOL("Foo")),
            user([{"type": "tool_result", "content": [TEXT(" out ")]}]), {"type": "pr-link", "prNumber": 7, "prRepository": "o/r", "prUrl": "u"}, user("more"),
        )
    )
    rows = vault.messages(parsed)
    got = [(r.turn_index, r.message_index, r.line_no, r.role, r.text) for r in rows.orderBy("turn_index", "message_index").collect()]
    assert got == [(0, 0, 2, "user", "hi"), (0, 1, 3, "assistant", "yes\nBash ls\nFoo"), (0, 2, 4, "tool", "out"), (0, 3, 5, "system", "PR #7 o/r u"), (1, 0, 6, "user", "more")]
    facts = vault.sessions(parsed, rows).first()
    assert (facts.title, facts.cwd, facts.branch, facts.message_count) == ("new", "/w", "b", 3)


def test_import_plan(spark):
    have = spark.createDataFrame([("a", "h", 10), ("b", "h", 10), ("c", "h", 10)], "session string, content_hash string, size_bytes long").withColumn("archived_at", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([("a", "h", 10), ("b", "x", 10), ("c", "x", 9), ("d", "x", 1)], "session string, content_hash string, size_bytes long")
    assert {r.session: r.status for r in vault.import_plan(new, have, F.lit("2024-02-01")).collect()} == {"a": "skipped", "b": "updated", "c": "skipped", "d": "new"}


def test_composite_hash_frames_names_and_contents(spark):
    import hashlib

    files_ = spark.createDataFrame([("s", "b", b"2"), ("s", "a", b"1x")], "session string, relative_path string, content binary")
    raw = b"".join(len(x).to_bytes(8, "big") + x for x in (b"a", b"1x", b"b", b"2"))
    row = vault.composite_hash(files_).first()
    assert row.content_hash == hashlib.sha256(raw).hexdigest() and row.size_bytes == 3


def test_row_for_line(spark):
    rows = spark.createDataFrame([("s", 2, 0), ("s", 5, 0)], "session string, line_no long, message_index int")
    wanted = spark.createDataFrame([("s", x) for x in (0, 2, 4, 9)], "session string, line long")
    assert [r.message for r in vault.row_for_line(rows, wanted).orderBy("line").collect()] == [0, 0, 0, 1]


def test_lookup_needs_eight_characters(spark):
    df = spark.createDataFrame([("12345678-a",), ("12345678-b",)], "session string")
    assert all(r.ambiguous for r in vault.lookup(df, "12345678").collect())
    with pytest.raises(ValueError):
        vault.lookup(df, "1234")


def test_line_scan(spark):
    df = spark.createDataFrame([(1, "a\r\n\nbb\n" + "x" * 20 + "\nc")], "k int, content string")
    got = [(r.line_no, r.line) for r in files.whole_lines(df, most=10).orderBy("line_no").collect()]
    assert got == [(0, "a"), (2, "bb"), (4, "c")]


def test_discover_and_restore(spark, tmp_path):
    uuid = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    root = tmp_path / "proj"
    (root / uuid / "subagents").mkdir(parents=True)
    (root / f"{uuid}.jsonl").write_text("{}\n")
    (root / uuid / "subagents" / "agent-1.jsonl").write_text("{}\n")
    (root / uuid / "note.txt").write_text("n")
    got = {(r.session, r.project_dir, r.relative_path, r.is_subagent) for r in files.discover(spark, str(root)).collect()}
    assert got == {(uuid, "proj", "", False), (uuid, "proj", "subagents/agent-1.jsonl", True), (uuid, "proj", "note.txt", False)}
    rows = spark.createDataFrame([("a/b.txt", b"x")], "relative_path string, content binary")
    assert files.restore(rows, str(tmp_path / "out")) == 1 and (tmp_path / "out/a/b.txt").read_bytes() == b"x"
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(ValueError):
            files.restore(spark.createDataFrame([(bad, b"x")], "relative_path string, content binary"), str(tmp_path / "out"))


def test_html():
    got = pages.markdown("<head><title>t</title></head><nav>n</nav><h1>T</h1><p>a <b>b</b> <a href='/x'>l</a></p><ul><li>1</li><li>2</li></ul><script>x</script><pre>p\n q</pre>")
    assert got == "# T\n\na **b** [l](/x)\n\n- 1\n- 2\n\n```\np\n q\n```"


def test_streaming_sweep_sees_a_file_once(spark, tmp_path):
    from lexspark.streaming import sweeps

    src, seen = tmp_path / "src", []
    src.mkdir()
    (src / "s1.jsonl").write_text("a\nb\n")
    each = lambda df, _: seen.extend((r.session, r.line) for r in df.collect())
    for _ in range(2):
        sweeps.sweep(spark, str(src), str(tmp_path / "cp"), each).awaitTermination()
    assert sorted(seen) == [("s1", "a"), ("s1", "b")]
