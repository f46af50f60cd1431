"""The engine's tables, made from the star schema and the text tables by fixed rules.

sources are documents: kind by id, indexed over 90 days, with accesses from events; chunks are those of redacted texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.text import redact, trim
from ..operators import chunking, index, lifecycle

AS_OF = "2024-03-15 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer splits than there are cores are dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "conversations") and df.rdd.getNumPartitions() < cores else df


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, text: redacted."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), redact(F.coalesce("text", F.lit(""))).alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, chunk_no, chunk_id, title, content, has_code, content_type."""
    return chunking.chunk_plain(documents(spark, sf_dir), "source_id").withColumn("chunk_id", index.chunk_id())


def stored_index(spark: SparkSession, sf_dir: str) -> index.Stored:
    """The stored index of the chunks; written at the first call of a session."""
    return index.Stored(spark, store.once(spark, "index", sf_dir, lambda at: index.write_index(chunks(spark, sf_dir), at)))


def bare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, label, kind, indexed_at, content_hash."""
    d = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("durable", "ephemeral", "session"))), (d % 3 + 1).cast("int"))
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (d % 90) * 86_400_000_000)
    docs = read(spark, sf_dir, "documents")
    return docs.select(d.alias("source_id"), F.concat(F.lit("doc:"), d.cast("string")).alias("label"), kind.alias("kind"), at.alias("indexed_at"), lifecycle.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


def kept_chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the chunks, written: for what reads them more than once, so that texts are redacted and cut once."""
    return store.kept(chunks(spark, sf_dir).select(*columns), "chunks")


def sources(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Of chunks that are at hand, or made: bare_sources with access_count, last_accessed_at, chunk_count, code_chunk_count (a fifth of the sources count as code)."""
    seen = read(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).groupBy(F.col("user_id").alias("source_id"))
    log = seen.agg(F.count("*").alias("access_count"), F.max(F.col("ts").cast("timestamp")).alias("last_accessed_at"))
    pieces = (chunks(spark, sf_dir) if of is None else of).groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    code = F.when(F.col("source_id") % 5 == 0, F.col("chunk_count")).when(F.col("source_id") % 5 == 1, 1).otherwise(0)
    joined = bare_sources(spark, sf_dir).join(log, "source_id", "left").join(pieces, "source_id", "left").fillna(0, ["access_count", "chunk_count"])
    return joined.withColumn("code_chunk_count", code)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, line_no, role, text, tools, tool_lines of conversations; system rows are summaries."""
    c = read(spark, sf_dir, "conversations").where(trim(F.coalesce("text", F.lit(""))) != "")
    none = F.array().cast("array<string>")
    role = F.when(F.col("role") == "system", "away_summary").otherwise(F.col("role"))
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), role.alias("role"), trim("text").alias("text"), none.alias("tools"), none.alias("tool_lines"))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, start_time: an hour apart."""
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("conv_id") * 3_600_000_000)
    return ids.select(F.col("conv_id").cast("string").alias("session"), at.alias("start_time"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, line_no, line: conversations as JSON log lines, assistants with a tool use, users as plain strings."""
    c = read(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    uuid = F.concat_ws("-", "conv_id", "turn")
    at = F.date_format(F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("conv_id") * 3_600_000_000 + F.col("turn") * 60_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    user = F.struct(F.lit("user").alias("type"), uuid.alias("uuid"), at.alias("timestamp"), F.lit("/work").alias("cwd"), F.struct(F.lit("user").alias("role"), text.alias("content")).alias("message"))
    tool = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("Read").alias("name"), uuid.alias("id"), F.struct(F.concat(F.lit("/f/"), "turn").alias("file_path")).alias("input")))
    said = F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    head = F.to_json(F.struct(F.lit("assistant").alias("type"), uuid.alias("uuid"), at.alias("timestamp")))
    mine = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"message":{"id":"m'), uuid, F.lit('","role":"assistant","content":['), said, F.lit(","), tool, F.lit("]}}"))
    away = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("away_summary").alias("subtype"), uuid.alias("uuid"), at.alias("timestamp"), text.alias("content")))
    rows = c.withColumn("h", head)
    line = F.when(F.col("role") == "user", F.to_json(user)).when(F.col("role") == "assistant", mine).otherwise(away)
    return rows.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), line.alias("line"))
