"""A bounded sample of labelled documents, shared by the two text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, table


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """text, label (0/1) of at most ``most`` labelled texts that are not held out, the same for the same rows. It is written
    once, so a fit that reads it often reads ``docs`` once.

    Several labels of one document: their mean decides, half counts as 1; of one text: the largest. Null ids and null labels
    are left out, a null text is the empty one. The list of ids is at most ``most`` longs, so it is broadcast; a doc_id with
    many rows and texts can't bring more than ``most`` texts either.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
    known = known.where(~held_out).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # copies of a text say no more than one
    found = table(texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("label").alias("label")), "sample")
    if found.count() <= most:
        return found
    keys = found.select(F.xxhash64("text").alias("key")).distinct().orderBy("key").limit(most)
    return table(found.join(F.broadcast(keys), F.xxhash64("text") == F.col("key"), "left_semi"), "sample")


def held_out(n: int, remainder: int) -> Column:
    return id_remainder(n) == remainder
