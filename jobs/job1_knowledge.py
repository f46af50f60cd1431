"""Rebuild the knowledge base: redacted documents in chunks by kind, the sources that stay by retention tier, and what was
evicted or rejected with its reason.

    python -m jobs.job1_knowledge --config jobs/job1_knowledge.json --documents PATH --events PATH --out PATH

Each run writes the whole base anew for the time ``as_of``, so a rerun over the same tables gives the same files' rows.

Rows without an id, or over ``most_bytes`` (before redaction), are rejected; so are rows whose text another row of a smaller
id has already, and further texts of one id ("repeated"). A null text is the empty one. A source's kind follows from its
origin by ``kinds``: the first pattern that matches. It counts as indexed when the log first names it, else at ``since``.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from lexspark import store
from lexspark.functions.text import redact
from lexspark.operators import chunking, lifecycle

log = logging.getLogger("jobs.knowledge")

TABLES = {"chunks": "kind", "sources": "tier", "evicted": "eviction_reason", "rejected": "reason"}


@dataclass(frozen=True)
class Settings:
    documents: str
    events: str
    out: str
    as_of: str = "2024-03-15 00:00:00"
    since: str = "2024-01-01 00:00:00"
    kinds: tuple[tuple[str, str], ...] = (("[05]$", "session"), ("[1-4]$", "ephemeral"), ("", "durable"))
    most_bytes: int = lifecycle.MAX_SOURCE_BYTES
    #: Characters of chunks beyond which a source is evicted.
    most_content: int = lifecycle.MAX_SOURCE_BYTES
    accesses: tuple[tuple[str, ...], ...] = (("view", "click"),)


def _kind(origin, kinds):
    found = F.when(F.lit(False), "")
    for pattern, kind in kinds:
        found = found.when(F.coalesce(origin, F.lit("")).rlike(pattern), kind)
    return found.otherwise("ephemeral")


def _documents(spark: SparkSession, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, text: redacted ones that may stay; source_id, origin, content_hash, row: one each; rejected rows). Texts are written
    once, and which of them stay is found by ids, hashes and row numbers alone."""
    raw = spark.read.parquet(s.documents)
    text = F.coalesce("text", F.lit(""))
    rows = raw.select(F.col("doc_id").cast("long").alias("source_id"), F.col("source").alias("origin"), F.octet_length(text).cast("long").alias("bytes"), redact(text).alias("text"))
    rows = rows.withColumn("content_hash", lifecycle.content_hash("text"))
    wrong = F.when(F.col("source_id").isNull(), "no id").when(F.col("bytes") > s.most_bytes, "too large")
    marked = rows.withColumn("reason", wrong).withColumn("text", F.when(F.col("reason").isNull(), F.col("text")))
    marked = store.kept(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    right = marked.where("reason is null")
    # a text belongs to the smallest id that has it, an id has the first of its texts
    facts = right.groupBy("source_id", "content_hash").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("origin").alias("origin"), F.min("row").alias("row"))
    facts = store.kept(facts, "facts")
    owners = facts.groupBy("content_hash").agg(F.min("source_id").alias("source_id"))
    chosen = owners.groupBy("source_id").agg(F.min("content_hash").alias("content_hash")).withColumn("chosen", F.lit(True))
    facts = facts.join(chosen, ["source_id", "content_hash"], "left")
    repeated = facts.where("chosen is null or rows > 1").select("source_id", "content_hash", "bytes", F.lit("repeated").alias("reason"), (F.col("rows") - F.coalesce(F.col("chosen").cast("int"), F.lit(0))).alias("rows"))
    other = marked.where("reason is not null").groupBy("source_id", "content_hash", "bytes", "reason").agg(F.count("*").alias("rows"))
    return right.select("row", "text"), facts.where("chosen").select("source_id", "origin", "content_hash", "row"), repeated.unionByName(other)


def run(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    """The tables that were written, read back."""
    texts, docs, rejected = _documents(spark, s)
    coded = chunking.has_code(F.col("content"))
    counts = chunking.chunk_plain(texts, "row").groupBy("row").agg(F.count("*").alias("chunk_count"), F.count_if(coded).alias("code_chunk_count"), F.sum(F.length("content")).alias("content_bytes"))
    events = spark.read.parquet(s.events).select(F.col("user_id").cast("long").alias("source_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").isin(*s.accesses[0]).alias("access"))
    seen = events.groupBy("source_id").agg(F.min("at").alias("first_at"), F.count_if("access").alias("access_count"), F.max(F.when(F.col("access"), F.col("at"))).alias("last_accessed_at"))
    indexed = F.coalesce("first_at", F.lit(s.since).cast("timestamp")).alias("indexed_at")
    sources = docs.join(seen, "source_id", "left").join(counts, "row", "left").fillna(0, ["access_count", "chunk_count", "code_chunk_count", "content_bytes"])
    sources = sources.select("row", "source_id", "origin", _kind(F.col("origin"), s.kinds).alias("kind"), "content_hash", "chunk_count", "code_chunk_count", "access_count", indexed, "last_accessed_at", F.col("chunk_count").alias("chunk_rows"), "content_bytes")
    judged = store.kept(lifecycle.judged(sources, F.lit(s.as_of).cast("timestamp"), s.most_content), "judged")
    left = judged.where("eviction_reason is null")
    # written, so that few of them are known to be few; only the texts of sources that stay are cut into chunks to keep
    staying = store.kept(left.select("row", F.struct("source_id", "kind").alias("of")), "staying")
    pieces = chunking.chunk_plain(texts.join(staying, "row"), "of")
    made = {
        "chunks": pieces.select("of.source_id", "chunk_no", "title", "content", coded.alias("has_code"), "of.kind"),
        "sources": left.drop("row", "chunk_rows", "content_bytes", "eviction_reason"), "evicted": judged.where("eviction_reason is not null").drop("row"), "rejected": rejected,
    }
    log.info("read %s and %s", s.documents, s.events)
    written = {}
    for name, df in made.items():
        df.write.mode("overwrite").partitionBy(TABLES[name]).parquet(f"{s.out}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{s.out}/{name}")
        log.info("wrote %s/%s: %s", s.out, name, {r[0]: r[1] for r in written[name].groupBy(TABLES[name]).count().collect()})
    return written


if __name__ == "__main__":
    common.main(Settings, run, __doc__.split(":")[0])
