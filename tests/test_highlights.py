"""Marks in bytes against a loop over the text."""

import re

from pyspark.sql import functions as F

from lexspark.functions.porter import stem
from lexspark.operators import chunking, highlights, index, ranking

TEXTS = [
    "walking with a license, walks LICENSED", "no hit here", "İstanbul license — über walking", "fail over the failover; fail\nover", "", "license", "über-cool license 中文 walking walking",
]
QUERIES = [(1, "walking license"), (2, "fail over"), (3, "über"), (4, "absent")]


def expected(text: str, terms: set[str]) -> list[tuple[int, int]]:
    """Single-token terms only."""
    stems, out = {stem(t) for t in terms}, []
    for m in re.finditer(r"İ|[^\W_İ]+İ?", text):
        low = m[0].lower().replace("̇", "").translate(str.maketrans("ü", "u"))
        if stem(low) in stems:
            at = len(text[: m.start()].encode())
            out.append((at, at + len(m[0].encode())))
    return out


def made(spark, tmp_path, queries=QUERIES, expand=False):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "source_id long, text string")
    chunks = chunking.chunk_plain(docs, "source_id").withColumn("chunk_id", index.chunk_id())
    index.write_index(chunks, str(tmp_path / "index"))
    stored = index.Stored(spark, str(tmp_path / "index"))
    groups = ranking.word_groups(spark.createDataFrame(queries, "query_id int, query string"), expand)
    every = chunks.select("chunk_id").crossJoin(groups.select("query_id").distinct())
    return highlights.marks(stored, every, groups), groups


def test_marks_are_bytes_of_the_text_as_written(spark, tmp_path):
    found, _ = made(spark, tmp_path)
    shown = found.withColumns({"text": highlights.highlighted("content", "marks"), "plain": highlights.stripped(highlights.highlighted("content", "marks"))})
    got = {(r.query_id, r.chunk_id >> 20): r for r in shown.collect()}
    terms = {1: {"walking", "license"}, 2: {"fail"}, 3: {"uber"}, 4: {"absent"}}
    for query_id, words in terms.items():
        for no, text in enumerate(TEXTS):
            want = expected(text, words)
            row = got.pop((query_id, no), None)
            marks = [tuple(m) for m in row.marks] if row else []
            assert marks == want, (query_id, text)
            if row:
                assert row.plain == text
                assert [len(x.encode()) for x in re.findall("\x02(.*?)\x03", row.text)] == [e - s for s, e in want]
    assert not got


def test_phrases_are_one_mark(spark, tmp_path):
    found, _ = made(spark, tmp_path, [(1, "x")])
    assert found.count() == 0
    groups = spark.createDataFrame([(1, 0, "fail-over"), (1, 1, "over the")], "query_id int, group_no int, term string")
    stored = index.Stored(spark, str(tmp_path / "index"))
    marks = highlights.marks(stored, spark.createDataFrame([(1, 3 << 20)], "query_id int, chunk_id long"), groups).first().marks
    # "fail over" and "over the" share a word; the second "fail\nover" stands alone
    assert [tuple(m) for m in marks] == [(0, 13), (24, 33)]


def test_span_is_the_least_window(spark):
    cases = [("a b . a . . b", [["a"], ["b"]]), ("a . . b . a", [["a"], ["b"]]), ("a a", [["a"], ["b"]]), ("b", [["a", "b"]]), ("c a b . c . a b", [["a"], ["b"], ["c"]])]
    rows = [(no, text, [(m.start(), m.end()) for m in re.finditer("[abc]", text)], groups) for no, (text, groups) in enumerate(cases)]
    df = spark.createDataFrame(rows, "no int, content string, marks array<struct<start:bigint,end:bigint>>, groups array<array<string>>")
    got = [r.span for r in df.select("no", highlights.span("content", "marks", "groups").alias("span")).orderBy("no").collect()]
    want = [ranking.min_span([[s for s, e in marks if text[s:e] in g] for g in groups]) if all(any(text[s:e] in g for s, e in marks) for g in groups) else None for _, text, marks, groups in rows]
    assert got == want == [2, 4, None, 0, 4]


def test_long_line_and_empty_batch(spark):
    df = spark.createDataFrame([(1, "wörd " * 20_000), (2, ""), (3, "...")], "chunk_id long, content string")
    got = highlights.token_bytes(df)
    assert got.count() == 20_000
    assert got.orderBy(F.desc("pos")).first().end == 20_000 * 6 - 1
