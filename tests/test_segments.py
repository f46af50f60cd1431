"""An index that changes by segments against one that is built afresh."""

import os

import pytest
from pyspark.sql import functions as F

from lexspark.operators import chunking, index
from lexspark.operators.segments import Segments
from lexspark.streaming import sweeps

ROWS = "label string, kind string, text string, seq long"
WORDS = ["alpha", "beta", "license", "running", "gamma"]
FIRST = [("a", "durable", "alpha beta beta", 1), ("b", "session", "alpha\nrunning license", 2), ("c", "durable", "gamma ray", 3), ("d", "wrong", "beta", 4), ("e", "durable", "", 5)]
SECOND = [("a", "durable", "alpha gamma", 1), ("b", "durable", "alpha\nrunning license", 2), ("c", "durable", "x", 3), ("c", "durable", None, 4), ("f", "ephemeral", "beta runs", 5), ("g", "session", None, 6)]
FINAL = {"a": "alpha gamma", "b": "alpha\nrunning license", "f": "beta runs", "e": ""}


def at(when: str = "2024-03-01"):
    return F.lit(when).cast("timestamp")


def hits(stored: index.Stored, names: dict[int, str]) -> list[tuple]:
    words = index.bm25(stored.word_hits(WORDS), stored.word_stats).collect()
    grams = index.bm25(stored.trigram_hits(WORDS), stored.trigram_stats).collect()
    return sorted((kind, r["term"], names[r["chunk_id"] >> 20], r["chunk_id"] & 0xFFFFF, round(r["score"], 9)) for kind, rows in (("word", words), ("gram", grams)) for r in rows)


def of(made: Segments) -> list[tuple]:
    return hits(made.open(), {r["source_id"]: r["label"] for r in made.sources().collect()})


def afresh(spark, texts: dict[str, str], path: str) -> list[tuple]:
    names = dict(enumerate(texts))
    docs = spark.createDataFrame([(i, texts[n]) for i, n in names.items()], "source_id long, text string")
    index.write_index(chunking.chunk_plain(docs, "source_id").withColumn("chunk_id", index.chunk_id()), path)
    return hits(index.Stored(spark, path), names)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    made = Segments(spark, str(tmp_path_factory.mktemp("segments")))
    for number, rows in enumerate((FIRST, SECOND)):
        made.apply(number, spark.createDataFrame(rows, ROWS), at(f"2024-03-0{number + 1}"))
    return made


def test_replaced_rekinded_deleted(spark, made, tmp_path):
    assert of(made) == afresh(spark, FINAL, str(tmp_path / "afresh"))
    log = {(r["segment"], r["label"]): r["action"] for r in made.log().collect()}
    assert log == {(0, "a"): "insert", (0, "b"): "insert", (0, "c"): "insert", (0, "e"): "insert", (1, "a"): "replace", (1, "b"): "rekind", (1, "c"): "delete", (1, "f"): "insert"}
    now = {r["label"]: r for r in made.sources().collect()}
    assert str(now["a"]["indexed_at"]) == "2024-03-02 00:00:00" and str(now["b"]["indexed_at"]) == "2024-03-01 00:00:00" and str(now["b"]["last_accessed_at"]) == "2024-03-02 00:00:00"
    assert now["b"]["kind"] == "durable" and len({r["source_id"] for r in now.values()}) == 4


def test_a_repeated_batch_changes_nothing(spark, made):
    before, rows = of(made), sorted(map(str, made.log().collect()))
    made.apply(1, spark.createDataFrame(SECOND, ROWS), at("2024-03-02"))
    assert of(made) == before and sorted(map(str, made.log().collect())) == rows


def test_a_batch_without_its_log_is_not_seen(spark, made):
    before = of(made)
    docs = spark.createDataFrame([(99, "alpha alpha")], "source_id long, text string")
    index.write_index(chunking.chunk_plain(docs, "source_id").withColumn("chunk_id", index.chunk_id()), made.path, 7)
    assert of(made) == before


def test_compacted(spark, made, tmp_path):
    small = made.compact(str(tmp_path / "small"))
    assert of(small) == of(made) and small.written() == [1]
    small.apply(2, spark.createDataFrame([("c", "durable", "gamma again", 1), ("a", "durable", None, 2)], ROWS), at("2024-03-03"))
    assert of(small) == afresh(spark, {k: v for k, v in FINAL.items() if k != "a"} | {"c": "gamma again"}, str(tmp_path / "afresh"))


def test_sweep_into_an_index(spark, tmp_path):
    root, checkpoint = tmp_path / "files", str(tmp_path / "checkpoint")
    root.mkdir()
    made = Segments(spark, str(tmp_path / "index"))

    def sweep(**files: str) -> dict[str, str]:
        for name, text in files.items():
            (root / name.replace("_", ".")).write_text(text)
        sweeps.into_index(spark, str(root), checkpoint, made).awaitTermination()
        stored = made.open()
        chunks = {r["source_id"]: r["content"] for r in stored.read("chunks").collect()}
        return {os.path.basename(r["label"]): chunks[r["source_id"]] for r in made.sources().collect()}

    assert sweep(a="alpha", b="beta one") == {"a": "alpha", "b": "beta one"}
    assert sweep() == {"a": "alpha", "b": "beta one"} and made.written() == [0]
    assert sweep(a_2="gamma", b_2=" \n", c="running", a_10="license") == {"a": "license", "c": "running"}
    assert {r["term"] for r in made.open().word_hits(WORDS).collect()} == {"license", "running"}
