"""What queries may hold and move as their input grows: by their plans, and by what they write."""

import contextlib
import io
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import chunking, index
from lexspark.plans import catalogue, search


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def keyed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")
    return chunking.chunk_plain(docs, "source_id").withColumn("chunk_id", index.chunk_id())


def test_vocabulary_is_gathered_in_hash_tables(spark):
    chunks = keyed(spark, ["beta alpha beta", "alpha gamma", ""]).withColumn("chunk_id", F.when(F.col("source_id") == 1, F.lit(2**62 + 5)).otherwise(-F.col("chunk_id")))
    found = index.vocabulary(chunks)
    assert "SortAggregate" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {("beta", 0, 0), ("alpha", 0, 1), ("gamma", 2**62 + 5, 1)} and found.dtypes == [("word", "string"), ("chunk_id", "bigint"), ("no", "int")]


def test_postings_are_a_row_for_a_stem_and_a_run_of_chunks(spark, tmp_path):
    index.write_index(keyed(spark, ["alpha beta alpha", "beta running", "runs İx", "x" * 3] * 30).coalesce(1), str(tmp_path))
    words = spark.read.schema(index._TABLES["words"]).parquet(f"{tmp_path}/words")
    parts = spark.read.parquet(f"{tmp_path}/chunks").rdd.getNumPartitions()
    rows = words.where("stem = 'beta'").collect()
    assert len(rows) <= parts and sum(len(r["chunk_ids"]) for r in rows) == 60 and sum(len(r["places"]) for r in rows) == sum(sum(r["title_ns"]) + sum(r["ns"]) for r in rows)
    stored = index.Stored(spark, str(tmp_path))
    assert sorted(map(tuple, stored.places(["run"]).where("col = 1").select(F.shiftright("chunk_id", 20), "pos").collect())) == sorted([(4 * i + 1, 1) for i in range(30)] + [(4 * i + 2, 0) for i in range(30)])
    assert stored.word_stats == index.word_stats(keyed(spark, ["alpha beta alpha", "beta running", "runs İx", "x" * 3] * 30))


def test_runs_are_bounded_in_rows_and_size():
    sizes = np.array([1] * 5000 + [3_000_000, 1, 1_500_000, 1_500_000])
    runs = list(index._runs(sizes))
    assert [a for a, _ in runs] == list(np.cumsum([0, *(n for _, n in runs)]))[:-1] and sum(n for _, n in runs) == len(sizes)
    assert all(n <= index.RUN and (n == 1 or sizes[a : a + n].sum() <= index.RUN_SIZE) for a, n in runs)


def test_trigrams_of_any_character():
    batch = pa.RecordBatch.from_pydict({"chunk_id": [1, 2, 3], "t": ["abc", None, "ab"], "c": ["xab\U0001f600b", "abc", ""]})
    rows = {r["gram"]: r["chunk_ids"] for b in index._grammed(iter([batch])) for r in b.to_pylist()}
    assert rows == {"abc": [1, 2], "xab": [1], "ab\U0001f600": [1], "b\U0001f600b": [1]}


def test_a_run_of_chunks_takes_few_bytes_a_token():
    tokens = [[["title"], [f"w{i * j % 5000}" if j % 2 else "running" for j in range(100)]] for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([101] * 2000, pa.int64()), pa.array(tokens, pa.list_(pa.list_(pa.string())))], names=["chunk_id", "dl", "tokens"])
    tracemalloc.start()
    rows = sum(len(b.column(5).values) for b in index._stemmed(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 202_000 and most < 40 * rows


def test_long_chunks_come_in_small_batches(spark, tmp_path, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"stem": str(b.nbytes), "chunk_ids": b.column(0).to_pylist(), "dls": [], "title_ns": [], "ns": [], "places": []}], schema=pa.schema([("stem", pa.string()), ("chunk_ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("dls", "title_ns", "ns", "places")]]))

    monkeypatch.setattr(index, "_stemmed", sizes)
    monkeypatch.setattr(index, "BATCH", "1m", raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    index.write_index(keyed(spark, ["\n".join(["ab " * 1500] * 800)]), str(tmp_path))
    found = spark.read.schema(index._TABLES["words"]).parquet(f"{tmp_path}/words").collect()
    assert sum(len(r["chunk_ids"]) for r in found) == 45 and max(int(r["stem"]) for r in found) < 2**21
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_token_count(spark):
    df = spark.createDataFrame([("Ä b-c İx \u0301e 12",), ("",), ("ÀÉ_é",)], "x string")
    assert all(r[0] == r[1] for r in df.select(text.token_count("x"), F.size(text.word_tokens("x"))).collect())


def test_places_of_some_terms_leave_the_others_in_their_chunk(spark):
    chunks = keyed(spark, ["alpha beta alpha", "gamma"])
    found = index.postings(chunks, ["alpha", "gamma"]).where("col = 1")
    assert sorted(map(tuple, found.collect())) == [(0, 1, 0, "alpha"), (0, 1, 2, "alpha"), (2**20, 1, 0, "gamma")]


def test_a_candidate_text_is_joined_once_for_all_terms(spark, tmp_path):
    chunks = keyed(spark, ["banana Ananas", "nana ban", "aaaa"])
    index.write_index(chunks, str(tmp_path))
    terms = ["ana", "ban", "nan", "aaa"]
    hits = index.Stored(spark, str(tmp_path)).trigram_hits(terms)
    assert "collect_list" in plan(hits)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, index.trigram_hits(chunks, terms).where("title_hits + content_hits > 0").collect()))


def test_many_terms_are_counted_in_one_pass_over_the_texts(spark, tmp_path):
    """The texts are read, and no lists of trigrams; overlaps, other scripts and borders of texts count as with few terms."""
    texts = ["aaaa banana", "aa", "", "bananaban ana", "ÄÖÜß äöü 🙂🙂🙂🙂", "nab", "anan", "a.b*c a.b*c", "x" * 3000 + "yz"]
    chunks = keyed(spark, texts).cache()
    index.write_index(chunks, str(tmp_path))
    terms = ["aaa", "ana", "anana", "banana", "äöü", "🙂🙂🙂", "a.b*c", "xyz", "xxxxx", "nanab", "an", "x" * 40, *(f"ban{i}" for i in range(120))]
    dead = spark.createDataFrame([(0,)], "source_id long")
    for stored, left in ((index.Stored(spark, str(tmp_path)), chunks), (index.Stored(spark, str(tmp_path), dead=dead), chunks.where("source_id <> 0"))):
        hits = stored.trigram_hits(terms)
        assert not [f for f in hits.inputFiles() if "/grams/" in f] and [f for f in stored.trigram_hits(terms[:9]).inputFiles() if "/grams/" in f]
        expected = index.trigram_hits(left, [t for t in terms if len(t) > 2]).where("title_hits + content_hits > 0")
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, expected.collect())) and hits.dtypes == expected.dtypes


def test_terms_that_begin_alike_are_compared_in_parts(monkeypatch):
    terms = [f"abc{i:03}" for i in range(500)]
    texts = [f"abcab{'c' * (i % 3)} abc{i % 500:03}abc{i % 7:03}" for i in range(300)] + [None, "", "abc"]
    expected = sorted((i * 500 + k, t.count(w)) for i, t in enumerate(texts) for k, w in enumerate(terms) if t and w in t)
    count = index._Counter(terms)
    parts = []
    monkeypatch.setattr(index, "RUN_SIZE", 5000)
    monkeypatch.setattr(count, "_compared", lambda *x, f=count._compared: parts.append(count.n[x[-1]].sum()) or f(*x))
    held, times = count(pa.array(texts, pa.string()))
    assert list(zip(held, times, strict=True)) == expected and len(parts) > 9 and max(parts) <= 5500


def test_groups_beyond_one_word_of_bits(spark, tmp_path):
    words = [f"word{i}" for i in range(70)]
    chunks = keyed(spark, [" ".join(words), " ".join(words[:69])])
    index.write_index(chunks, str(tmp_path))
    sources = spark.createDataFrame([(0, "a", "durable"), (1, "b", "durable")], "source_id long, label string, kind string")
    corpus = search.Indexed(index.Stored(spark, str(tmp_path)), sources)
    found = search.search(corpus, spark.createDataFrame([(1, " ".join(words))], "query_id int, query string")).collect()
    assert [r["label"] for r in found] == ["a"]


def test_hints_of_secrets_are_no_alternation(spark):
    odd = ["TOKEN = " + "b" * 30, "<PRIVATE>x</private>", "no more", "Key: " + "c" * 30, "sk-" + "a" * 25, "", None, "AKIA" + "A" * 16, "akia" + "A" * 16]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    found = df.select(text.redact("x").alias("out"))
    assert "RLIKE" not in plan(found)
    mark = "[REDACTED_SECRET]"
    assert [r[0] for r in found.collect()] == [mark, "[REDACTED]", "no more", odd[3], mark, "", None, mark, odd[8]]


def test_tokens_are_split_off_once_and_folded_by_the_stemmer(spark, tmp_path):
    df = spark.createDataFrame([("Éa b-c, 12",), (",",), ("",), (None,)], "x string")
    found = df.select(text.word_tokens("x"), text.token_count("x"))
    assert "extract_all" not in plan(found) and "regexp_count" not in plan(found)
    assert [r[0] for r in found.collect()] == [["ea", "b", "c", "12"], [], [], None]
    index.write_index(keyed(spark, ["Éclairs éclair", "eclair"]), str(tmp_path))
    hits = index.Stored(spark, str(tmp_path)).word_hits(["éclair"]).collect()
    assert sorted((r["chunk_id"] >> 20, r["content_hits"]) for r in hits) == [(0, 2), (1, 1)]


def test_spellings_are_one_short_expression(spark):
    words = spark.createDataFrame([("a", 1, 2), ("abcdef", 3, 4), ("é" * 7, 5, 6), ("x" * 20, 7, 8)], "word string, chunk_id long, no int")
    found = index.spellings(words)
    assert plan(found).count("xxhash64") == 1
    sizes = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count_distinct("key").alias("n")).collect()}
    assert sizes == {"a": 6, "abcdef": 4, "é" * 7: 8, "x" * 20: 5}
    probes = index.spelling_probes(spark.createDataFrame([("abcxef",), ("x" * 21,)], "word string"))
    met = probes.withColumnRenamed("word", "asked").join(found, "key").select("asked", "word").distinct().collect()
    assert {("abcxef", "abcdef"), ("x" * 21, "x" * 20)} == set(map(tuple, met))


def test_vocabulary_without_decimals_where_the_numbers_fit(spark, tmp_path):
    chunks = keyed(spark, ["beta alpha beta", "alpha gamma", "", "İİİ delta"])
    index.write_index(chunks, str(tmp_path))
    held = spark.read.schema(index._CHUNKS).parquet(f"{tmp_path}/chunks")
    fits = index._fits(held)
    assert fits and "decimal" not in plan(index.vocabulary(held, fits))
    assert sorted(map(tuple, index.vocabulary(held, fits).collect())) == sorted(map(tuple, index.vocabulary(chunks).collect()))
    assert index._fits(held.withColumn("chunk_id", F.col("chunk_id") + F.when(F.col("source_id") > 0, 2**62).otherwise(-(2**62)))) is None and index._fits(held.where("false")) is None


def test_only_words_of_sources_with_three_chunks_are_counted(spark):
    chunks = keyed(spark, ["\n".join(f"alpha beta_{i} w{i % 2}ord" for i in range(60)), "alpha beta", "one\ntwo"]).select("source_id", "chunk_no", "content")
    found = index.distinctive_terms(chunks.unionByName(chunks.where("source_id = 2")).unionByName(chunks.where("source_id = 2")))
    steps = plan(found)
    assert 0 <= steps.index("Generate explode") < steps.index("BroadcastHashJoin")
    assert {r["source_id"] for r in found.collect()} == {0, 2}


def test_chunks_are_made_once_and_read(spark):
    for name in ("intent_summary", "evict_apply"):
        assert "posexplode" not in plan(catalogue.ALL[name](spark, "/root/testdata/sf0.001")), name
