"""Discovery of session files, and the archive sink: imports twice, poisoned sessions, other versions, tried again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexspark.sources import files
from lexspark.streaming.archive import Archive, into_archive

ROWS = "session string, project_dir string, relative_path string, content binary"


def log(*texts: str) -> bytes:
    said = [{"type": "user" if i % 2 == 0 else "assistant", "uuid": f"u{i}", "timestamp": f"2024-01-02T03:04:0{i}Z", "message": {"role": "user", "id": f"m{i}", "content": [{"type": "text", "text": t}]}} for i, t in enumerate(texts)]
    return "\n".join(map(json.dumps, said)).encode()


def at(day: int = 1):
    return F.lit(f"2024-03-0{day}").cast("timestamp")


def outcome(rows) -> dict[str, str]:
    return {r.session: r.status for r in rows.collect()}


def state(archive: Archive) -> tuple:
    return (
        sorted((r.session, r.title, r.message_count, r.size_bytes, str(r.archived_at)) for r in archive.sessions().collect()),
        sorted((r.session, r.turn_index, r.message_index, r.role, r.text) for r in archive.messages().collect()),
        sorted((r.session, r.relative_path, bytes(r.content)) for r in archive.files().collect()),
        sorted((r.session, r.error) for r in archive.quarantine().collect()),
    )


FIRST = [
    ("a", "-p", "", log("hello", "world")), ("a", "-p", "note.txt", b"n"), ("b", "-p", "", log("only")), ("headless", "-p", "x.txt", b"x"), ("binary", "-p", "", b"\xff\xfe{}"),
    ("broken", "-p", "", b"no json\nat all"), ("empty", "-p", "", None), ("twice", "-p", "", log("q")), ("twice", "-p", "", log("q")), ("out", "-p", "", log("q")), ("out", "-p", "../x", b"x"), (None, "-p", "", log("q")),
]
ERRORS = [("", "no session"), ("binary", "not UTF-8"), ("broken", "no readable line"), ("empty", "no readable line"), ("headless", "no main log"), ("out", "unsafe path"), ("twice", "repeated path")]


def test_import_quarantines_and_keeps_the_rest(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    rows = spark.createDataFrame(FIRST, ROWS)
    got = outcome(archive.apply(0, rows, at(1)))
    assert got == {"a": "new", "b": "new"} | {s: "error" for s, _ in ERRORS}
    first = state(archive)
    assert first[3] == ERRORS and [m[4] for m in first[1]] == ["hello", "world", "only"] and [f[:2] for f in first[2]] == [("a", ""), ("a", "note.txt"), ("b", "")]
    # the same batch tried again, and the same rows as another batch
    archive.apply(0, rows, at(1))
    assert state(archive) == first
    assert {s for s, x in outcome(archive.apply(1, rows, at(2))).items() if x == "skipped"} == {"a", "b"}
    assert state(archive)[:3] == first[:3]
    # a larger version and a mended session come in, a smaller one does not; the time of the first import stays
    second = [("a", "-p", "", log("hello", "world", "more")), ("a", "-p", "note.txt", b"n"), ("b", "-p", "", b"{}"), ("broken", "-p", "", log("mended"))]
    assert outcome(archive.apply(2, spark.createDataFrame(second, ROWS), at(3))) == {"a": "updated", "b": "skipped", "broken": "new"}
    last = state(archive)
    assert [m[4] for m in last[1]] == ["hello", "world", "more", "only", "mended"] and "broken" not in {s for s, _ in last[3]}
    assert {s[0]: s[4] for s in last[0]} == {"a": "2024-03-01 00:00:00", "b": "2024-03-01 00:00:00", "broken": "2024-03-03 00:00:00"}


def test_a_batch_without_its_manifest_is_not_seen(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    archive.apply(0, spark.createDataFrame([("a", "-p", "", log("one"))], ROWS), at())
    before = state(archive)
    # a batch that stopped before its last write
    archive._put(spark.createDataFrame([("a", "", b"y")], "session string, relative_path string, content binary"), "files", 1)
    assert state(archive) == before
    archive.apply(1, spark.createDataFrame([("c", "-p", "", log("two"))], ROWS), at())
    assert [f[:2] for f in state(archive)[2]] == [("a", ""), ("c", "")]


def test_empty_import(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "archive"))
    assert archive.apply(0, spark.createDataFrame([], ROWS), at()).count() == 0 and state(archive) == ([], [], [], [])


def put(root, path: str, content: bytes = b"{}\n") -> None:
    to = root / path
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_bytes(content)


def found(spark, root) -> set[tuple]:
    return {(r.project_dir, r.session, r.relative_path) for r in files.discover(spark, str(root)).collect()}


def test_three_layouts(spark, tmp_path):
    for name in ("-p", "-q r+%"):
        put(tmp_path / "conf/projects", f"{name}/s1.jsonl")
        put(tmp_path / "conf/projects", f"{name}/s1/subagents/agent-1.jsonl")
    put(tmp_path / "conf", "settings/x.jsonl")
    put(tmp_path / "conf/projects", "-p/orphan/x.txt")
    put(tmp_path / "conf/projects", "-p/notes.md")
    of = lambda p: {(p, "s1", ""), (p, "s1", "subagents/agent-1.jsonl")}
    both = of("-p") | of("-q r+%")
    assert found(spark, tmp_path / "conf") == both
    assert found(spark, tmp_path / "conf/projects") == both
    assert found(spark, tmp_path / "conf/projects/-p") == of("-p")
    assert found(spark, tmp_path / "conf/projects/-p/") == of("-p")


def test_links_and_sizes(spark, tmp_path, monkeypatch):
    root = tmp_path / "p"
    put(root, "s.jsonl")
    put(root, "s/small.txt", b"x" * 10)
    put(root, "s/large.txt", b"x" * 100)
    put(root, "s/subagents/agent-1.jsonl", b"x" * 100)
    put(tmp_path, "secret/inner.txt")
    os.symlink(tmp_path / "secret/inner.txt", root / "t.jsonl")
    os.symlink(tmp_path / "secret", root / "s/linked")
    monkeypatch.setattr(files, "SIDECAR_BYTES", 50)
    assert {(s, r) for _, s, r in found(spark, root)} == {("s", ""), ("s", "small.txt"), ("s", "subagents/agent-1.jsonl")}


def test_sweeps_archive_whole_sessions(spark, tmp_path):
    root, archive = tmp_path / "root", Archive(spark, str(tmp_path / "archive"))
    put(root, "-p/s1.jsonl", log("one"))
    put(root, "-p/s1/note.txt", b"n")
    sweep = lambda day: into_archive(spark, str(root), str(tmp_path / "checkpoint"), archive, at(day)).awaitTermination()
    sweep(1)
    first = state(archive)
    assert [m[4] for m in first[1]] == ["one"] and len(first[2]) == 2
    sweep(2)
    assert state(archive) == first
    # a new sidecar makes its session another version; a new session comes in beside it
    put(root, "-p/s1/subagents/agent-1.jsonl", log("sub"))
    put(root, "-p/s2.jsonl", log("two"))
    put(root, "-p/s3.jsonl", b"poison")
    sweep(3)
    last = state(archive)
    assert [f[:2] for f in last[2]] == [("s1", ""), ("s1", "note.txt"), ("s1", "subagents/agent-1.jsonl"), ("s2", "")] and last[3] == [("s3", "no readable line")]


def test_restore_in_tasks(spark, tmp_path):
    rows = [(f"d{i % 7}/f{i}.txt", str(i).encode()) for i in range(200)]
    df = spark.createDataFrame(rows, "relative_path string, content binary").repartition(8)
    for _ in range(2):
        assert files.restore(df, str(tmp_path / "out")) == 200
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*.txt")} == dict(rows)
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".txt"]
    with pytest.raises(ValueError):
        files.restore(df.union(df.limit(1)), str(tmp_path / "out"))
    os.symlink(tmp_path, tmp_path / "out/link")
    with pytest.raises(Exception, match="leads out"):
        files.restore(spark.createDataFrame([("link/x", b"x")], "relative_path string, content binary"), str(tmp_path / "out"))
