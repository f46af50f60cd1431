"""Access logs, search throttling, debouncing and tool statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a throttle window, calls with two results, calls with one; bytes of a token.
WINDOW_S, FULL, SOME, TOKEN_BYTES = 60, 3, 8, 4


def track(sources: DataFrame, log: DataFrame) -> DataFrame:
    """sources with access_count and last_accessed_at after a log of (search_id, source_id, at): one access per search and source."""
    once = log.groupBy("search_id", "source_id").agg(F.max("at").alias("at"))
    sums = once.groupBy("source_id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    joined = sources.join(sums, "source_id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).withColumn("last_accessed_at", F.coalesce(F.greatest("at", "last_accessed_at"), "last_accessed_at")).drop("n", "at")


def throttle(calls: DataFrame, start: Column, window_s: int = WINDOW_S) -> DataFrame:
    """Calls (client, at) with count in its window and limit (2, 1, 0: blocked). A window begins at ``start`` and then at the
    first call after the last one ended; calls are dealt by client, sorted, and folded as they stream past."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = calls.select("client", micros.alias("us"), F.unix_micros(start.cast("timestamp")).alias("start")).repartition("client").sortWithinPartitions("client", "us")
    kind = calls.schema["client"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begin, n, fresh = None, 0, 0, True
        for batch in batches:
            counts = []
            for client, us, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if fresh or client != now:
                    now, begin, n, fresh = client, first, 0, False
                if us - begin > window_s * 1_000_000:
                    begin, n = us, 0
                n += 1
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32())], names=["client", "us", "count"])

    limit = F.when(F.col("count") > SOME, 0).when(F.col("count") > FULL, 1).otherwise(2)
    return rows.mapInArrow(run, f"client {kind}, us long, count int").select("client", F.timestamp_micros("us").alias("at"), "count").withColumn("limit", limit)


def debounce(events: DataFrame, key: str, at: str, gap_ms: int = 200) -> DataFrame:
    """Events that no other of the same key follows within ``gap_ms``."""
    nxt = F.lead(F.unix_micros(F.col(at).cast("timestamp"))).over(W.partitionBy(key).orderBy(at))
    gap = nxt - F.unix_micros(F.col(at).cast("timestamp"))
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > gap_ms * 1000)).drop("gap")


def first_of(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def tool_stats(calls: DataFrame) -> DataFrame:
    """Calls (tool, raw_bytes, shown_bytes): per tool and (tool null) in all calls, bytes, tokens, ratio and reduction."""
    sums = calls.groupingSets([["tool"], []], "tool").agg(F.count("*").alias("calls"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("shown_bytes").alias("shown_bytes"))
    shown = F.greatest(F.col("shown_bytes"), F.lit(1))
    return sums.select(
        "tool", "calls", "raw_bytes", "shown_bytes", F.floor(F.col("shown_bytes") / TOKEN_BYTES).alias("tokens"), (F.col("raw_bytes") / shown).alias("ratio"),
        F.when(F.col("raw_bytes") > 0, 100.0 * (1 - F.col("shown_bytes") / F.col("raw_bytes"))).otherwise(0.0).alias("reduction"),
    )


def sweep_status(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (session, mtime, sub_mtime) against indexed (label, indexed_at): status new, changed or current."""
    known = indexed.select(F.substring_index("label", ":", -1).alias("session"), "indexed_at")
    latest = known.groupBy("session").agg(F.max("indexed_at").alias("indexed_at"))
    newest = F.greatest("mtime", F.coalesce("sub_mtime", "mtime"))
    status = F.when(F.col("indexed_at").isNull(), "new").when(newest > F.col("indexed_at"), "changed").otherwise("current")
    return files.join(latest, "session", "left").withColumn("status", status)


def outcome_counts(planned: DataFrame) -> DataFrame:
    """status, n of a sweep or an import; ``total`` counts all."""
    counted = planned.groupingSets([["status"], []], "status").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce("status", F.lit("total")).alias("status"), "n")
