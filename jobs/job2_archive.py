"""Archive session logs: take the turns that are new since the last run, redact them, and keep a card of each session.

    python -m jobs.job2_archive --config jobs/job2_archive.json --turns PATH --out PATH --checkpoint PATH

A file stream hands each new file to one batch, and the checkpoint knows which files were taken. A batch writes

* ``messages`` by bucket of the session and batch: only its own partitions, so a batch that is tried again replaces what it
  had written;
* ``rejected`` by reason and batch: rows without a session or turn, or of an unknown role;
* ``cards`` of the buckets that it touched, made anew from all of their messages.

A turn may be sent again, in a later file or the same one: :func:`current` has its latest version. Rows that are equal in
batch, session and turn are told apart by role and text, and the largest counts. A null text is the empty one.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from lexspark.functions.text import head, redact, trim

log = logging.getLogger("jobs.archive")

#: Characters of a title, and what makes a session worth indexing: answers and their bytes.
TITLE_CHARS, LEAST_ANSWERS, LEAST_BYTES = 120, 2, 200
MESSAGES = "conv_id long, turn long, role string, text string, bucket int, batch long"
CARDS = "conv_id long, title string, n_messages long, n_user long, n_assistant long, bytes long, first_turn long, last_turn long, indexable boolean, bucket int"
REJECTED = "conv_id long, turn long, role string, reason string, batch long"
ROLES = ("user", "assistant", "system")


@dataclass(frozen=True)
class Settings:
    #: A folder of files, or a pattern of files or folders.
    turns: str
    out: str
    checkpoint: str
    #: Partitions of sessions: a batch makes the cards of those that it touches anew. Fixed for the life of an archive.
    buckets: int = 16
    #: Tasks, and so files, for a bucket of a batch.
    spread: int = 2
    files_a_batch: int = 1000


def current(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, bucket: the latest version of each turn, added up before it is shuffled."""
    last = F.max(F.struct("batch", "role", "text")).alias("m")
    return messages.groupBy("bucket", "conv_id", "turn").agg(last).select("conv_id", "turn", "m.role", "m.text", "bucket")


def cards(now: DataFrame) -> DataFrame:
    """One row for each session of :func:`current`: its title is the first thing that a user says, on one line."""
    said = lambda role: F.col("role") == role
    first = F.min(F.when(said("user") & (F.col("text") != ""), F.struct("turn", "text")))["text"]
    answered = F.sum(F.when(said("assistant"), F.octet_length("text")).otherwise(0))
    made = now.groupBy("bucket", "conv_id").agg(
        F.coalesce(head(F.regexp_replace(first, r"[\r\n]+", " "), TITLE_CHARS), F.lit("")).alias("title"), F.count("*").alias("n_messages"), F.count_if(said("user")).alias("n_user"),
        F.count_if(said("assistant")).alias("n_assistant"), F.sum(F.octet_length("text")).alias("bytes"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        ((F.count_if(said("assistant") & (F.col("text") != "")) >= LEAST_ANSWERS) & (answered >= LEAST_BYTES)).alias("indexable"),
    )
    return made.select(*[c.split()[0] for c in CARDS.split(", ")])


def _put(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def batch(spark: SparkSession, s: Settings, new: DataFrame, batch_id: int) -> None:
    reason = F.when(F.col("conv_id").isNull(), "no session").when(F.col("turn").isNull(), "no turn").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown role")
    rows = new.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(batch_id).cast("long").alias("batch")).withColumn("reason", reason)
    _put(rows.where("reason is not null").select(*[c.split()[0] for c in REJECTED.split(", ")]), f"{s.out}/rejected", "reason", "batch")
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(s.buckets)).cast("int")
    messages = rows.where("reason is null").select("conv_id", "turn", "role", redact(trim(F.coalesce("text", F.lit("")))).alias("text"), bucket.alias("bucket"), "batch")
    # a session may hold most rows of a batch: its turns go to several tasks
    dealt = messages.repartition("bucket", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(s.spread)))
    _put(dealt, f"{s.out}/messages", "bucket", "batch")
    archive = spark.read.schema(MESSAGES).parquet(f"{s.out}/messages")
    mine = archive.where(F.col("batch") == batch_id)
    touched = {r["bucket"]: r["count"] for r in mine.groupBy("bucket").count().collect()}
    _put(cards(current(archive.where(F.col("bucket").isin(*touched)))), f"{s.out}/cards", "bucket")
    refused = spark.read.schema(REJECTED).parquet(f"{s.out}/rejected").where(F.col("batch") == batch_id).count()
    log.info("batch %d of %s: wrote %d messages and the cards of %d buckets to %s, rejected %d rows", batch_id, s.turns, sum(touched.values()), len(touched), s.out, refused)


def run(spark: SparkSession, s: Settings) -> None:
    """Take what is new, then stop."""
    for name, schema, parts in (("messages", MESSAGES, ("bucket", "batch")), ("cards", CARDS, ("bucket",)), ("rejected", REJECTED, ("reason", "batch"))):
        common.empty_if_missing(spark.createDataFrame([], schema), f"{s.out}/{name}", *parts)
    # files are taken whatever their age
    stream = spark.readStream.schema(spark.read.parquet(s.turns).schema).option("maxFilesPerTrigger", s.files_a_batch).option("maxFileAge", "36500d").parquet(s.turns)
    write = stream.writeStream.foreachBatch(lambda new, batch_id: batch(new.sparkSession, s, new, batch_id))
    query = write.option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None or not query.lastProgress["numInputRows"]:
        log.info("nothing new in %s", s.turns)


if __name__ == "__main__":
    common.main(Settings, run, __doc__.split(":")[0])
