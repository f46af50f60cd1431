"""Tables of the engine's own in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_once: dict[tuple[str, str], str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder for a local master, and else an error, since each
    machine of a cluster would write to another folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexspark-")
        found = _local[context.applicationId]
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new place under the root; what is written there goes with the process."""
    made = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, made))
    return made


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: worked out once, whatever reads it and whichever executors are lost."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def once(spark: SparkSession, name: str, of: str, write: Callable[[str], None]) -> str:
    """The place of what ``write`` has put there for an input ``of`` this session; it is written at the first call."""
    key = (spark.sparkContext.applicationId, f"{name} {of}")
    if key not in _once:
        at = path(spark, name)
        write(at)
        _once[key] = at
    return _once[key]


@atexit.register
def drop() -> None:
    """Remove what was written. A driver that lives long calls it when its results are out."""
    _once.clear()
    while _written:
        spark, at = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(at)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return
