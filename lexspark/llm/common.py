"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id inside an operator, so that ids sort and hash as plain longs.
NO_ID = -(2**63)

_tables: list[tuple[SparkSession, str]] = []


_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local master gets a temporary one of its
    own; on a cluster that would be another folder on each machine, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lexspark-")
        root = _own[context.applicationId]
    return root.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def drop_tables() -> None:
    """Remove the tables written by :func:`table`. A driver that lives long calls it once its results are written."""
    while _tables:
        spark, path = _tables.pop()
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its folder goes with it
            return


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts: fewer rows than the default 10,000."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """``docs`` as one struct column ``row``, and ``extra`` beside it: names of an operator's own can't clash with the input's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *extra)


def unpacked(df: DataFrame, columns: list[str], *extra: Column) -> DataFrame:
    """The columns of a :func:`packed` table under their own names, then ``extra``."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *extra)


def salted(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 32, how: str = "inner") -> DataFrame:
    """An equi-join whose left side may hold a third of its rows under one key: they are dealt to ``salts`` tasks by
    ``spread``, and each row of ``right`` (one per key, two or three numbers wide) goes to all of them."""
    dealt = left.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    every = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(every, [key, "salt_"], how).drop("salt_")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def plain_id(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def real_id(did: str = "did") -> Column:
    return F.when(F.col(did) != NO_ID, F.col(did))


def id_remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
