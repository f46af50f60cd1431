"""Incremental sweeps as Structured Streaming queries; :mod:`state` has what keeps state with timers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import Segments


def sweep(spark: SparkSession, root: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every log line under ``root`` that is new since the last sweep to ``each``, then stop. The checkpoint remembers files."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", True).load(root)
    named = lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1).alias("session"), F.col("value").alias("line"))
    return named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_index(spark: SparkSession, root: str, checkpoint: str, index: Segments, kind: str = "session") -> StreamingQuery:
    """Sweep text files under ``root`` into an index: a file is a source by its path. ``name.2``, ``name.3`` ... are later
    versions of ``name``, of which the last in a batch counts, and one of white space alone deletes its source (Spark reads no row of an empty file). A batch that is tried
    again leaves the index as if it had run once."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFileAge", "36500d").load(root)
    path = F.col("_metadata.file_path")
    seq = F.struct(F.coalesce(F.regexp_extract(path, r"\.(\d+)$", 1).try_cast("long"), F.lit(0)).alias("version"), path.alias("path"))
    label = F.concat(F.lit("file:"), F.regexp_replace(path, r"\.\d+$", ""))
    rows = files.select(label.alias("label"), F.lit(kind).alias("kind"), F.when(F.trim(F.translate("value", "\t\r\n", "   ")) != "", F.col("value")).alias("text"), seq.alias("seq"), F.col("_metadata.file_modification_time").alias("at"))

    def each(new: DataFrame, batch: int) -> None:
        index.apply(batch, new, F.lit(new.agg(F.max("at")).first()[0]))

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_session(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first event of each session and type; state older than ``delay`` is let go."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["session", "type"])
