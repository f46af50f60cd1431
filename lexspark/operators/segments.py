"""A stored index that changes: each batch of sources is a segment of its own, and readers merge segments.

A segment holds the postings of the sources that it brought, and a log of what it did to labels. Nothing written is changed:
a source that is replaced or deleted stays in its segment, and the log makes it dead. A batch writes its log last, so that
readers see all of it or nothing; tried again under its number, it replaces what it had written, with the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.text import redact
from . import chunking, index, lifecycle

_LOG = "label string, source_id long, kind string, content_hash string, action string, indexed_at timestamp, last_accessed_at timestamp, access_count long, segment long"
#: What the log says of a source that was taken away, beside insert, replace, rekind and skip.
_DELETE = "delete"


class Segments:
    """An index in the folder ``path``; ``upto`` leaves later segments out (none, if it is None)."""

    def __init__(self, spark: SparkSession, path: str, upto: int | None = None):
        self.spark, self.path, self.upto = spark, path, upto
        if upto is None:
            spark.createDataFrame([], _LOG).write.mode("ignore").partitionBy("segment").parquet(f"{path}/log")

    def log(self) -> DataFrame:
        rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        return rows if self.upto is None else rows.where(F.col("segment") <= self.upto)

    def sources(self) -> DataFrame:
        """source_id, label, kind, content_hash, indexed_at, last_accessed_at, access_count of the living: the last word on each label."""
        last = F.max_by(F.struct("source_id", "kind", "content_hash", "action", "indexed_at", "last_accessed_at", "access_count"), "segment").alias("x")
        return self.log().groupBy("label").agg(last).select("label", "x.*").where(F.col("action") != _DELETE).drop("action")

    def written(self) -> list[int]:
        """Numbers of the segments whose log is there."""
        return sorted(r[0] for r in self.log().select("segment").distinct().collect())

    def open(self) -> index.Stored:
        """The index of the living sources."""
        every = self.log().select("source_id").distinct()
        dead = store.kept(every.join(self.sources().select("source_id"), "source_id", "left_anti"), "dead")
        return index.Stored(self.spark, self.path, self.written(), dead)

    def apply(self, batch: int, incoming: DataFrame, as_of: Column) -> DataFrame:
        """Segment ``batch`` of incoming (label, kind, text, seq): the last row of a label counts, and a null text deletes it.

        The rest as in :func:`lifecycle.upsert_plan`, by the hash of the redacted text: a new text gets a new id and new
        counters, another kind or the same text only a new log row. Returns the log of the segment."""
        earlier = Segments(self.spark, self.path, batch - 1)
        known = store.kept(earlier.sources(), "known")
        clean = store.kept(incoming.select("label", "kind", "seq", redact("text").alias("text")).withColumn("content_hash", lifecycle.content_hash("text")), "incoming")
        last = clean.groupBy("label").agg(F.max("seq").alias("seq"))
        gone = clean.where("text is null").join(last, ["label", "seq"]).select("label").join(known, "label")
        plan = store.kept(lifecycle.upsert_plan(clean.select("label", "kind", "content_hash", "seq"), known).where("content_hash is not null"), "plan")
        top = earlier.log().agg(F.coalesce(F.max("source_id"), F.lit(-1))).first()[0]
        fresh = lifecycle.numbered(plan.where(F.col("action").isin("insert", "replace")), "seq", "source_id", top + 1)
        texts = clean.join(fresh.select("label", "seq", "source_id"), ["label", "seq"]).select("source_id", "text")
        chunks = chunking.chunk_plain(texts, "source_id").withColumn("chunk_id", index.chunk_id())
        index.write_index(chunks, self.path, batch)
        at = as_of.cast("timestamp")
        made = fresh.select("label", "source_id", "kind", "content_hash", "action", at.alias("indexed_at"), at.alias("last_accessed_at"), F.lit(0).cast("long").alias("access_count"))
        same = plan.where(F.col("action").isin("skip", "rekind")).select("label", "kind", "action").join(known.drop("kind"), "label")
        same = same.select("label", "source_id", "kind", "content_hash", "action", "indexed_at", at.alias("last_accessed_at"), "access_count")
        left = gone.select("label", "source_id", "kind", "content_hash", F.lit(_DELETE).alias("action"), "indexed_at", "last_accessed_at", "access_count")
        rows = made.unionByName(same).unionByName(left).withColumn("segment", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{self.path}/log")
        return self.log().where(F.col("segment") == batch)

    def compact(self, path: str) -> Segments:
        """The same index in a new folder, in one segment under the number of the last: readers and writers go on there."""
        number = max(self.written(), default=0)
        index.write_index(self.open().read("chunks"), path, number)
        rows = self.sources().withColumns({"action": F.lit("insert"), "segment": F.lit(number).cast("long")})
        rows.select(*[c.split()[0] for c in _LOG.split(", ")]).write.mode("overwrite").partitionBy("segment").parquet(f"{path}/log")
        return Segments(self.spark, path)
