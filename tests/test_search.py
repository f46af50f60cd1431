import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import index, ranking
from lexspark.plans import search

ROWS = [
    ("Database Pool", "The connection pool manages connections to postgres. pooling pools"), ("Cache", "caching layer for the database connection, été à paris"),
    ("Auth", "authentication tokens and continuous integration pipeline"), ("Misc", "nothing here about it at all, max-source bytes"), ("Other", "database database database"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, i, 0, t, c, "prose") for i, (t, c) in enumerate(ROWS, 1)], "chunk_id long, source_id long, chunk_no int, title string, content string, content_type string").persist()


def fts(tokenizer, match):
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table t using fts5(title, content, tokenize='{tokenizer}')")
    db.executemany("insert into t(rowid, title, content) values (?, ?, ?)", [(i, t, c) for i, (t, c) in enumerate(ROWS, 1)])
    return dict(db.execute("select rowid, bm25(t, 2.0, 1.0) from t where t match ?", (match,)).fetchall())


def scores(spark, chunks, terms, every, trigram=False):
    groups = spark.createDataFrame([(1, i, t) for i, t in enumerate(terms)], "query_id int, group_no int, term string")
    if trigram:
        scored = index.bm25(index.trigram_hits(chunks, groups.select("term")), index.trigram_stats(chunks))
    else:
        scored = index.bm25(index.word_hits(chunks, groups.select("term")), index.word_stats(chunks))
    return {r.chunk_id: r.score for r in ranking.layer(groups, scored, every).collect()}


@pytest.mark.parametrize("terms", [["database", "connection"], ["connection"], ["ete"], ["max-source"], ["database"], ["tokens", "pipeline"]])
def test_word_scores_equal_fts5(spark, chunks, terms):
    expected = fts("porter unicode61", " ".join(f'"{t}"' for t in terms))
    assert scores(spark, chunks, terms, True) == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("terms", [["nnect"], ["ete"], ["pool", "data"]])
def test_trigram_scores_equal_fts5(spark, chunks, terms):
    expected = fts("trigram", " OR ".join(f'"{t}"' for t in terms))
    assert scores(spark, chunks, terms, False, True) == pytest.approx(expected, rel=1e-9)


def test_query_terms(spark):
    q = lambda x: spark.createDataFrame([(x,)], "q string").select(ranking.query_terms("q")).first()[0]
    assert q('"Foo" bar, the FOO (baz)') == ["foo", "bar", "baz"]
    assert q("the and") == ["the", "and"]
    assert q("  ") == []


def test_groups(spark):
    queries = spark.createDataFrame([(1, "db AND été x-y ab")], "query_id int, query string")
    words = {(r.group_no, r.term) for r in ranking.word_groups(queries, True).collect()}
    assert {t for _, t in words} == {"db", "database", "datastore", "été", "x-y", "ab"}
    assert {r.term for r in ranking.trigram_groups(queries, True).collect()} == {"database", "datastore", "x-y"}


def test_min_span_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
        import itertools

        assert ranking.min_span(lists) == min(max(c) - min(c) for c in itertools.product(*lists))
    assert ranking.min_span([[5, 40], [20, 44]]) == 4


def test_fuse_collapses_namesakes(spark, chunks):
    ranked = spark.createDataFrame([(1, 1, -2.0, 0, "porter"), (1, 2, -1.0, 1, "porter"), (1, 1, -3.0, 0, "trigram")], "query_id int, chunk_id long, score double, rank0 int, layer string")
    same = chunks.withColumn("source_id", F.lit(9)).withColumn("title", F.lit("t"))
    row = ranking.fuse(ranked, same).first()
    assert row.fused_score == pytest.approx(2 / 60 + 1 / 61) and row.chunk_id == 1 and row.match_layer == "rrf(porter+trigram)"


def test_correct(spark):
    vocabulary = spark.createDataFrame([("authentication", 0, 0), ("nodes", 0, 1), ("modes", 1, 0)], "word string, chunk_id long, no int")
    words = spark.createDataFrame([("authentcation",), ("nodes",), ("bodes",), ("the",), ("db",), ("zzzzzz",), ("perf",)], "word string")
    got = {r.word: r.fixed for r in ranking.correct(words, index.spellings(vocabulary)).collect()}
    assert got == {"authentcation": "authentication", "nodes": None, "bodes": "nodes", "the": None, "db": None, "zzzzzz": None, "perf": None}


def test_diversify(spark):
    rows = [(1, s, r) for r, s in enumerate([7, 7, 7, 8, 7, 9], 1)]
    df = spark.createDataFrame(rows, "query_id int, source_id int, rank int")
    assert [r.rank for r in ranking.diversify(df, 5).orderBy("place").collect()] == [1, 2, 4, 6, 3]


def test_entities(spark):
    e = lambda x: spark.createDataFrame([(x,)], "q string").select(ranking.entities("q")).first()[0]
    assert e('The "auth flow" of SessionStore in My_Var and Foo') == ["auth flow", "SessionStore", "My_Var", "Foo"]
    assert e("Sessions expire") == [] and e("SessionStore expires") == ["SessionStore"]
    n = lambda c, names: spark.createDataFrame([(c,)], "c string").select(ranking.entity_matches("c", F.array(*map(F.lit, names)))).first()[0]
    assert n("Foo foo Foo.Foobar Foo", ["Foo"]) == 3 and n("auth FLOW x", ["Auth Flow"]) == 1 and n("Foo " * 9, ["Foo"]) == 5


def test_search_falls_back_corrects_and_filters(spark, chunks):
    sources = spark.createDataFrame([(i, f"doc:{i}", "ephemeral" if i == 5 else "durable") for i in range(1, 6)], "source_id long, label string, kind string")
    corpus = search.Corpus(chunks, sources)
    queries = spark.createDataFrame([(1, "db connection"), (2, "authentcation tokens"), (3, "postgres integration"), (4, "qqqqqqq")], "query_id int, query string")
    got = search.search(corpus, queries, search.Options(limit=3)).collect()
    by = lambda q: [(r.source_id, r.match_layer) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
    assert {s for s, _ in by(1)} == {1, 2}
    assert by(2)[0][0] == 3
    assert {s for s, _ in by(3)} == {1, 3}
    assert by(4) == []
    assert all(s != 5 for q in (1, 2, 3) for s, _ in by(q))
    named = search.search(corpus, queries.where("query_id = 1"), search.Options(limit=3, source="DOC:2")).collect()
    assert {r.source_id for r in named} == {2}


def test_flat_compatibility_drops_groups_with_synonyms(spark, chunks):
    sources = spark.createDataFrame([(i, f"doc:{i}", "durable") for i in range(1, 6)], "source_id long, label string, kind string")
    queries = spark.createDataFrame([(1, "db connection")], "query_id int, query string")
    flat = search.search(search.Corpus(chunks, sources), queries, search.Options(limit=5, compat="flat")).collect()
    assert {r.source_id for r in flat if not r.match_layer.startswith("fuzzy+")} == {1, 2}


def test_options():
    assert search.include_kinds(["Durable", "durable", " session "]) == ("durable", "session")
    with pytest.raises(ValueError):
        search.include_kinds(["other"])
    assert search.scope_includes(search.Options(), "ephemeral") is False
    assert search.scope_includes(search.Options(source="x"), "ephemeral") is True


def test_distinctive_terms_need_three_chunks(spark):
    rows = [(1, i, f"alpha_{i % 2} common words beta{i}") for i in range(4)] + [(2, 0, "gamma gamma")]
    df = spark.createDataFrame(rows, "source_id long, chunk_no int, content string")
    got = [(r.source_id, r.word) for r in index.distinctive_terms(df).orderBy("rank").collect()]
    assert got == [(1, "alpha_0"), (1, "alpha_1")]


def test_stored_index_gives_the_same_hits(spark, chunks):
    """Words, phrases, substrings and statistics of a written index against those of one pass over all chunks."""
    from lexspark import store

    at = store.path(spark, "index")
    keyed = chunks.withColumn("source_id", F.col("chunk_id")).withColumn("chunk_id", index.chunk_id())
    index.write_index(keyed, at)
    stored = index.Stored(spark, at)
    assert stored.word_stats == index.word_stats(keyed) and stored.trigram_stats == index.trigram_stats(keyed)
    words = ["database", "connection", "pools", "max-source", "ete", "tokens", "database connection", "nowhere"]
    parts = ["nnect", "ete", "pool", "data", "oo", "aaa", "database", "ing", "cac"]
    rows = lambda hits: sorted(tuple(r) for r in hits.select("term", "chunk_id", "dl", "title_hits", "content_hits").collect())
    assert rows(stored.word_hits(words)) == rows(index.word_hits(keyed, words)) and len(rows(stored.word_hits(words))) > 8
    assert rows(stored.trigram_hits(parts)) == rows(index.trigram_hits(keyed, [p for p in parts if len(p) > 2]))
    assert {r.word for r in stored.read("vocabulary").collect()} == {r.word for r in index.vocabulary(keyed).collect()}
    sources = spark.createDataFrame([(i, f"doc:{i}", "ephemeral" if i == 5 else "durable") for i in range(1, 6)], "source_id long, label string, kind string")
    queries = spark.createDataFrame([(1, "db connection"), (2, "authentcation tokens"), (3, "postgres integration"), (4, "qqqqqqq"), (5, "été max-source")], "query_id int, query string")
    for options in (search.Options(limit=3), search.Options(limit=2, source="doc:2"), search.Options(content_type="prose")):
        found = [sorted(tuple(r) for r in search.search(c, queries, options).collect()) for c in (search.Corpus(keyed, sources), search.Indexed(stored, sources))]
        assert found[0] == found[1] and found[0]
    plan = stored.word_hits(["database"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_vocabulary_of_very_large_source_ids(spark):
    df = spark.createDataFrame([(2**23 + 5, 0, "alpha beta alpha"), (2**40, 3, "gamma")], "source_id long, chunk_no int, content string").withColumn("chunk_id", index.chunk_id())
    got = {r.word: (r.chunk_id, r.no) for r in index.vocabulary(df).collect()}
    assert got == {"alpha": ((2**23 + 5) * 2**20, 0), "beta": ((2**23 + 5) * 2**20, 1), "gamma": (2**60 + 3, 0)}


def test_words_meet_all_that_are_near(spark):
    """Every pair within the allowed edits, over bytes, against the distance of all pairs."""
    rng = random.Random(3)
    known = ["".join(rng.choices("abé", k=rng.choice([3, 4, 5, 8, 10, 12, 13, 15, 16, 20]))) for _ in range(150)]

    def changed(w: str) -> str:
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :]])
        return w

    asked = sorted({changed(w) for w in known} - {""})
    words = spark.createDataFrame([(w,) for w in asked], "word string").where(F.octet_length("word") >= 3)
    vocabulary = spark.createDataFrame([(w, i, 0) for i, w in enumerate(sorted(set(known)))], "word string, chunk_id long, no int")
    edits = F.when(F.octet_length("word") <= 4, 1).when(F.octet_length("word") <= 12, 2).otherwise(3)
    all_pairs = words.crossJoin(vocabulary.select(F.col("word").alias("other"))).where(text.byte_levenshtein("word", "other") <= edits)
    keys = index.spelling_probes(words).join(index.spellings(vocabulary).withColumnRenamed("word", "other"), "key")
    met = keys.where(text.byte_levenshtein("word", "other") <= edits).select("word", "other").distinct()
    assert set(map(tuple, met.collect())) == set(map(tuple, all_pairs.collect())) and met.count() > 100
    rows = index.spellings(vocabulary).groupBy("word").count()
    assert rows.agg(F.max("count")).first()[0] <= 10
