"""Profiles of languages: vectors, bundles and cosines against loops, and accuracy on documents that are held out."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import language

SCHEMA = "doc_id long, text string, lang string"
DIM = 256


def sign(code: int, at: int, dim: int = DIM) -> int:
    """Sign ``at`` of a letter, by plain integers."""
    m = 2**64 - 1
    x = ((code * (dim // 64) + at // 64 + 1) * 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    x ^= x >> 31
    byte, bit = (x >> (8 * (at % 64 // 8))) & 255, 7 - at % 8
    return 2 * ((byte >> bit) & 1) - 1


def bundle(text: str) -> list[int] | None:
    blanked = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    letters = " ".join(blanked.split())
    if not letters:
        return None
    letters = f" {letters} "
    out = [0] * DIM
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        for i in range(DIM):
            out[i] += sign(ord(a), (i - 2) % DIM) * sign(ord(b), (i - 1) % DIM) * sign(ord(c), i)
    return out


def cosine(a, b) -> float:
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


TEXTS = [
    (1, "the other thing", "en"), (2, "whether the weather", "en"), (3, "ein, zwei; DREI und", "de"), (4, "nicht schön", "de"), (5, "été là-bas", "fr"), (6, "the", None),
    (7, "", "en"), (8, None, "fr"), (9, "123 ... !", "de"), (None, "über", "de"), (11, "日本語 の 文", "ja"), (11, "日本語 の 文", "ja"), (12, "a", "en"), (13, "Ως ΣΑΣ", "el"),
]


@pytest.mark.parametrize("piece", [language.PIECE, 3])
def test_against_loops(spark, monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    texts = [t for t in TEXTS if piece > 3 or t[2] != "el"]  # the last sigma of a word depends on what follows
    docs = spark.createDataFrame(texts, SCHEMA)
    model = language.learned(docs, DIM)
    sums: dict[str, list[int]] = {}
    for _, text, lang in texts:
        if lang and (b := bundle(text or "")):
            sums[lang] = [x + y for x, y in zip(sums.get(lang, [0] * DIM), b, strict=True)]
    assert model.languages == tuple(sorted(sums))
    for lang, vector in zip(model.languages, model.vectors, strict=True):
        np.testing.assert_allclose(vector, np.array(sums[lang]) / np.linalg.norm(sums[lang]), atol=1e-9)
    got = language.predict(docs.select("doc_id", "text", F.lit("x").alias("score")), model, F.col("doc_id"), F.col("text").alias("t"), dim=DIM).collect()
    for row in got:
        b = bundle(row["t"] or "")
        if b is None:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            near = {lang: cosine(b, s) for lang, s in sums.items()}
            assert math.isclose(near[row["lang_pred"]], max(near.values()), abs_tol=1e-6)
            assert math.isclose(row["score"], max(0.0, max(near.values())), abs_tol=1e-6)
    assert len(got) == len(texts)


def test_vectors_are_nearly_orthogonal():
    v = language.letter_vectors(np.arange(97, 123), 1024).astype(int)
    assert set(np.unique(v)) == {-1, 1}
    assert np.abs(v @ v.T - 1024 * np.eye(26, dtype=int)).max() < 160


def test_kept_vectors_do_not_change_bundles(monkeypatch):
    monkeypatch.setattr(language, "GRAMS", 16)
    monkeypatch.setattr(language, "KEPT", 24)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)).encode() for _ in range(5)] + [b"zz"]
    held = {p: v for p, v in language._bundles(texts, language._Vectors(DIM))}
    for place, text in enumerate(texts):
        assert held[place].tolist() == bundle(text.decode())


def test_odd_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language.digest(none).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None), (2, None, None)], SCHEMA)
    assert [tuple(r) for r in language.digest(unlabelled).orderBy("doc_id").select("doc_id", "lang_pred", "score").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    broken = spark.createDataFrame([(1, "the thing of the", "en"), (3, "x " * 1_500_000, "xx")], SCHEMA).withColumn("text", F.expr("cast(concat(cast(text as binary), X'FFFE') as string)"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(broken, language.learned(broken)).collect()} == {1: "en", 3: "xx"}


def test_held_out_accuracy_and_independence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.digest(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97
    # what is held out teaches nothing, and its own label is not looked at
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = language.digest(docs.withColumn("lang", F.when(out, F.lit("zz")).otherwise(F.col("lang")))).where("held_out")
    assert {(r["doc_id"], r["lang_pred"]) for r in other.collect()} == {(r["doc_id"], r["lang_pred"]) for r in got}
