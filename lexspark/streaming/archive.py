"""The session archive as a sink: whole sessions go in, those that can't be kept are set apart with their error.

A batch writes, each by its own partitions, ``quarantine``, ``files``, ``messages`` and, last, ``sessions``: the manifest. Readers
take of each session the rows of the last batch that the manifest names, so they see all of a batch or nothing of it, and a batch
that is tried again replaces itself. What is archived is never changed; a larger or equally large other version stands over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import store
from ..operators import sessions, vault
from ..sources import files

_SESSIONS = "session string, project_dir string, title string, cwd string, branch string, start_time timestamp, end_time timestamp, message_count long, content_hash string, size_bytes long, archived_at timestamp, status string, batch long"
_FILES = "session string, relative_path string, content binary, batch long"
_MESSAGES = "session string, turn_index long, message_index long, line_no int, role string, text string, ts timestamp, batch long"
_QUARANTINE = "session string, error string, size_bytes long, batch long"
_TABLES = {"sessions": _SESSIONS, "files": _FILES, "messages": _MESSAGES, "quarantine": _QUARANTINE}


class Archive:
    """An archive in the folder ``path``; ``upto`` leaves later batches out (none, if it is None)."""

    def __init__(self, spark: SparkSession, path: str, upto: int | None = None):
        self.spark, self.path, self.upto = spark, path, upto
        if upto is None:
            for name, schema in _TABLES.items():
                spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch").parquet(f"{path}/{name}")

    def _read(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")
        return rows if self.upto is None else rows.where(F.col("batch") <= self.upto)

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        columns = [c.split()[0] for c in _TABLES[name].split(", ")]
        made = rows.withColumn("batch", F.lit(batch).cast("long")).select(*[F.col(c).cast(k) for c, k in (x.split() for x in _TABLES[name].split(", "))])
        made.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def sessions(self) -> DataFrame:
        """The archived sessions, each as its last batch left it."""
        rows = self._read("sessions")
        last = rows.groupBy("session").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["session", "batch"])

    def quarantine(self) -> DataFrame:
        """session, error, size_bytes, batch of what was refused and has not come in since."""
        later = self._read("sessions").groupBy("session").agg(F.max("batch").alias("kept"))
        return self._read("quarantine").join(later, "session", "left").where("kept is null or kept < batch").drop("kept")

    def _of(self, name: str) -> DataFrame:
        return self._read(name).join(self.sessions().select("session", "batch"), ["session", "batch"], "left_semi")

    def files(self) -> DataFrame:
        return self._of("files")

    def messages(self) -> DataFrame:
        return self._of("messages")

    def apply(self, batch: int, incoming: DataFrame, as_of: Column) -> DataFrame:
        """Import session, project_dir, relative_path ('' for the main log), content (binary): all files of each session.

        Returns session, status (new, updated, skipped, error), size_bytes of all that came. A session is refused if it has no
        main log, several of one path, a path that leads out of its folder, or a log that is no UTF-8 or holds no line that
        can be read; the others of its batch are kept. Null contents are empty files; rows without a session are refused as ''."""
        earlier = Archive(self.spark, self.path, batch - 1)
        rows = incoming.select(F.coalesce("session", F.lit("")).alias("session"), "project_dir", F.coalesce("relative_path", F.lit("")).alias("relative_path"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
        rows = store.kept(rows, "incoming")
        main = rows.where("relative_path = ''")
        readable = main.where(F.is_valid_utf8(F.col("content").cast("string")))
        lines = files.whole_lines(readable.select("session", "content"))
        parsed = store.kept(sessions.parse_lines(lines), "parsed")
        whole = vault.composite_hash(rows)
        paths = rows.groupBy("session").agg(F.count_if(F.col("relative_path") == "").alias("mains"), (F.count("*") - F.count_distinct("relative_path")).alias("repeated"), F.count_if((F.col("relative_path") != "") & ~files.safe_relative(F.col("relative_path"))).alias("unsafe"))
        read = parsed.select("session").distinct().withColumn("read", F.lit(True))
        valid = readable.select("session").distinct().withColumn("valid", F.lit(True))
        checked = whole.join(paths, "session").join(read, "session", "left").join(valid, "session", "left")
        error = F.when(F.col("session") == "", "no session").when(F.col("mains") == 0, "no main log").when(F.col("repeated") > 0, "repeated path").when(F.col("unsafe") > 0, "unsafe path")
        error = error.when(F.col("valid").isNull(), "not UTF-8").when(F.col("read").isNull(), "no readable line")
        checked = store.kept(checked.select("session", "content_hash", "size_bytes", error.alias("error")), "checked")
        plan = store.kept(vault.import_plan(checked.where("error is null").drop("error"), earlier.sessions(), as_of), "plan")
        taken = plan.where("status <> 'skipped'")
        mine = lambda df: df.join(taken.select("session"), "session", "left_semi")
        said = store.kept(vault.messages(mine(parsed)), "messages")
        folders = rows.groupBy("session").agg(F.max("project_dir").alias("project_dir"))
        self._put(checked.where("error is not null"), "quarantine", batch)
        self._put(mine(rows), "files", batch)
        self._put(said, "messages", batch)
        self._put(vault.sessions(mine(parsed), said).join(taken, "session").join(folders, "session"), "sessions", batch)
        refused = checked.where("error is not null").select("session", F.lit("error").alias("status"), "size_bytes")
        return plan.select("session", "status", "size_bytes").union(refused)


def into_archive(spark: SparkSession, root: str, checkpoint: str, archive: Archive, as_of: Column) -> StreamingQuery:
    """Sweep a folder of session logs into an archive: files that are new tell which sessions have changed, and all files of
    those are read again, since a session is archived as a whole. Stops when it has seen what is there."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    seen = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFileAge", "36500d").load(root)

    def each(new: DataFrame, batch: int) -> None:
        found = files.listed(new.select("path", "length", "modificationTime"), root)
        changed = found.select("session").distinct()
        every = files.discover(spark, root).join(changed, "session", "left_semi")
        archive.apply(batch, every.select("session", "project_dir", "relative_path", "content"), as_of)

    return seen.select("path", "length", "modificationTime").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
