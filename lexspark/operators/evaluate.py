"""Retrieval metrics per case and group, comparison of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed loss of a metric, and how far below it a change counts.
LOSS, EPSILON = -0.02, 1e-4
#: Metrics that may not lose anything.
STRICT = ("match_layer_accuracy", "avg_context_recall", "perfect_recall_rate")


def relevance(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results (query_id, rank, content) of cases (query_id, needles): adds relevant, and found (numbers of needles held)."""
    held = F.filter(F.transform("needles", lambda n, i: F.when(F.contains("content", n), i)), lambda i: i.isNotNull())
    joined = results.join(cases.select("query_id", "needles"), "query_id")
    return joined.withColumn("found", held).withColumn("relevant", F.size("found") > 0)


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, doc_id, content: documents (doc_id, content) that hold an item's text (query_id, text) as it is.

    Three words of the item, its first left out, stand in such a document too: items and documents meet on their hash, and
    only pairs that do are compared. Items of fewer than five words have no such words: they are few and short, and compared
    with every document."""
    words = lambda c: F.split(F.trim(c), r"\s+")
    three = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    wanted = items.select("query_id", "text", words("text").alias("w"))
    keyed = wanted.where(F.size("w") >= 5).select("query_id", "text", three(F.col("w"), F.lit(1)).alias("h"))
    split = docs.select("doc_id", words("content").alias("w"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 3)), lambda i: three(F.col("w"), i)))
    met = split.select("doc_id", F.explode(runs).alias("h")).join(F.broadcast(keyed), "h").select("query_id", "doc_id", "text").distinct()
    long = docs.join(met, "doc_id").where(F.contains("content", F.col("text"))).select("query_id", "doc_id", "content")
    short = docs.join(F.broadcast(wanted.where(F.size("w") < 5)), F.contains("content", F.col("text"))).select("query_id", "doc_id", "content")
    return long.union(short)


def case_metrics(results: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """Of each case: recall at 1, 3, 5 and 10, ndcg (the ideal from the relevant results found), mrr, context_recall, false_positive.

    Cases without needles are negative: anything found is a false positive, and their context recall is 1.
    """
    rated = relevance(results, cases)
    at = lambda n: F.coalesce(F.max((F.col("relevant") & (F.col("rank") <= n)).cast("double")), F.lit(0.0))
    gain = F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)))
    n = F.count_if(F.col("relevant") & (F.col("rank") <= k))
    per = rated.groupBy("query_id").agg(
        *[at(i).alias(f"recall_at_{i}") for i in (1, 3, 5, 10)], gain.alias("gain"), n.alias("n"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("needles_found"), F.count("*").alias("returned"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    joined = cases.join(per, "query_id", "left")
    size = F.size("needles")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        *cases.columns, *[zero(F.col(f"recall_at_{i}")).alias(f"recall_at_{i}") for i in (1, 3, 5, 10)], zero(F.when(F.col("n") > 0, F.col("gain") / ideal)).alias("ndcg_at_10"),
        zero(1.0 / F.col("first")).alias("mrr"), F.when(size == 0, 1.0).otherwise(zero(F.col("needles_found") / size)).alias("context_recall"), ((size == 0) & (F.coalesce("returned", F.lit(0)) > 0)).alias("false_positive"),
    )


def layer_checks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Of positive cases (with expected_layer, and a ceiling of the first relevant rank, 0: none): layer_match (the first
    result's match_layer), first (rank of the first relevant result, 0: none), ceiling_pass (null without a ceiling), failure
    (match_layer, no_results, rank_ceiling, or null)."""
    rated = relevance(results, cases)
    per = rated.groupBy("query_id").agg(F.min_by("match_layer", "rank").alias("layer"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    joined = cases.where(F.size("needles") > 0).join(per, "query_id", "left").withColumn("first", F.coalesce("first", F.lit(0)))
    match = F.coalesce(F.col("layer") == F.col("expected_layer"), F.lit(False))
    within = (F.col("first") > 0) & (F.col("first") <= F.col("ceiling"))
    failure = F.when(F.col("layer").isNull(), "no_results").when(~match, "match_layer").when((F.col("ceiling") > 0) & ~within, "rank_ceiling")
    return joined.select(*cases.columns, match.alias("layer_match"), "first", F.when(F.col("ceiling") > 0, within).alias("ceiling_pass"), failure.alias("failure"))


def compression(summary: Column, whole: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.octet_length(summary) / F.octet_length(whole))


def context_reduction(cases: DataFrame) -> DataFrame:
    """Of cases (needles, returned: results of the search, context_recall, compression): compression, recall, perfect and
    effective (compression times recall). A negative case without results scores 1 in all; with some, its compression only."""
    negative, clean = F.size("needles") == 0, F.coalesce("returned", F.lit(0)) == 0
    of = lambda positive, other: F.when(~negative, positive).when(clean, 1.0).otherwise(other).cast("double")
    recall = F.col("context_recall")
    shown = F.when(negative & clean, 1.0).otherwise(F.col("compression"))
    return cases.select(*[c for c in cases.columns if c not in ("context_recall", "compression")], shown.alias("compression"), of(recall, 0.0).alias("recall"), of((recall == 1).cast("double"), 0.0).alias("perfect"), of(F.col("compression") * recall, 0.0).alias("effective"))


#: What a report calls the means of context_reduction.
REDUCTION = {"compression": "avg_compression_ratio", "recall": "avg_context_recall", "perfect": "perfect_recall_rate", "effective": "avg_effective_compression"}


def reduction_summary(reduced: DataFrame, group: str = "content_type") -> DataFrame:
    """Means over all cases, negative ones too, by group and (group null) overall."""
    return reduced.groupingSets([[group], []], group).agg(*[F.avg(a).alias(b) for a, b in REDUCTION.items()])


def layer_summary(checked: DataFrame, group: str = "content_type") -> DataFrame:
    """match_layer_accuracy and rank_ceiling_pass_rate (over cases with a ceiling) by group and overall."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return checked.groupingSets([[group], []], group).agg(rate("layer_match").alias("match_layer_accuracy"), rate("ceiling_pass").alias("rank_ceiling_pass_rate"))


def summary(metrics: DataFrame, group: str = "content_type") -> DataFrame:
    """Means over positive cases by group and (group null) overall, in one pass; counts of positive and negative cases."""
    positive = F.size("needles") > 0
    names = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "ndcg_at_10", "mrr")
    means = [F.avg(F.when(positive, F.col(c))).alias(c) for c in names]
    both = [F.avg(F.when(positive, F.col("context_recall"))).alias("avg_context_recall"), F.avg("context_recall").alias("avg_context_recall_all")]
    counts = [F.count_if(positive).alias("case_count"), F.count_if(~positive).alias("negative_case_count"), F.count_if(F.col("false_positive")).alias("negative_false_positive_count")]
    return metrics.groupingSets([[group], []], group).agg(*means, *both, *counts)


def same_dataset(base_hash: str, target_hash: str) -> None:
    """Reports over different fixtures can't be compared."""
    if base_hash != target_hash:
        raise ValueError(f"the reports are over different datasets: {base_hash} and {target_hash}")


def compare(base: DataFrame, target: DataFrame, loss: float = LOSS) -> DataFrame:
    """Reports in long form (content_type, metric, value) -> both values, delta and regression."""
    joined = base.withColumnRenamed("value", "base").join(target.withColumnRenamed("value", "target"), ["content_type", "metric"], "full")
    delta = F.coalesce("target", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))
    allowed = F.when(F.col("metric").isin(*STRICT), 0.0).otherwise(loss)
    return joined.withColumn("delta", delta).withColumn("regression", (F.col("delta") < allowed - EPSILON) & (F.abs("delta") >= EPSILON))


def failure_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """case_id, type, change: failures that are new, and those resolved."""
    keys = ["case_id", "type"]
    one = lambda a, b, name: a.select(keys).distinct().join(b.select(keys), keys, "left_anti").withColumn("change", F.lit(name))
    return one(target, base, "new").union(one(base, target, "resolved"))


def rank_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, pre_rank, post_rank, delta: positive is better."""
    joined = before.withColumnRenamed("rank", "pre_rank").join(after.withColumnRenamed("rank", "post_rank"), "case_id")
    return joined.withColumn("delta", F.col("pre_rank") - F.col("post_rank"))
