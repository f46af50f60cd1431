"""The pipeline on a small corpus with planted cases, held against what each stage should leave."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    text = lambda i, n=90: " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + f"\nown {i}"
    texts = ["common line\n" + text(i) for i in range(120)]
    item = " ".join(f"bench{k}" for k in range(30))
    texts[40] += "\n" + item
    texts[50] = texts[51]
    for i in range(60, 120, 3):
        texts[i] = texts[i].replace("\nown", " vileword badword vileword badword vileword\nown")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    toxic = {i for i in range(60, 120, 3)}
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = docs, set(range(120))
    expected = [left - toxic, left - toxic, left - toxic - {51}, left - toxic - {51, 40}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        assert {r.doc_id for r in now.select("doc_id").collect()} == ids, name
    assert not any("common line" in r.text for r in now.collect()) and all(r.n_chars == len(r.text) for r in now.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == expected[-1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, and tables without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, did long, rk long, row string, key string"
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(0, None), (1, ""), (2, " \n "), (None, "an unnamed text of some words"), (None, None), (5, long), (6, long + " more"), (7, "short"), (7, "short"), (8, "shared line\n" * 30), (9, "one two three four five six")]
    rows = [(i, t, None, None, None, 1, 2, "r", "k") for i, t in rows]
    labels = [(i, i % 2, int(i == 8)) for i in range(10)] + [(None, 1, 1), (4, None, None)]
    for name, docs, known, items in (("odd", rows, labels, [(1, "one two three four five six"), (None, None), (2, "")]), ("none", [], [], [])):
        at = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        frame = spark.read.parquet(f"{at}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            frame = function(spark, frame, at)
            assert frame.columns == [x.split()[0] for x in schema.split(", ")], stage
        pieces = corpus_pipeline.run(spark, at).collect()
        kept = {r.doc_id for r in pieces}
        if name == "odd":
            assert 5 in kept and 6 not in kept and 9 not in kept and 7 in kept and len([r for r in pieces if r.doc_id == 7]) == 1
        else:
            assert not pieces


def test_decontamination_of_a_long_text_of_one_repeated_item(spark, tmp_path):
    """The stage drops it, and holds no more of it at once than a block's hits."""
    item = " ".join(f"r{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join([item] * 667)), (2, "something else"), (None, item), (None, None)], "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert {(r.doc_id, r.text) for r in left.collect()} == {(2, "something else"), (None, None)}
