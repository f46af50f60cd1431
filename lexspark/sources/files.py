"""Log files, session folders, fixtures and reports as DataFrames; restored files."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes a log line may have, and a sidecar file.
LINE_BYTES, SIDECAR_BYTES = 16 * 1024 * 1024, 5 * 1024 * 1024


def whole_lines(texts: DataFrame, text: str = "content", most: int = LINE_BYTES) -> DataFrame:
    """The other columns, line_no (the physical line, from 0), line without a final CR. Oversized and empty lines are dropped
    but counted; a final line end begins no further line."""
    others = [c for c in texts.columns if c != text]
    body = F.regexp_replace(F.col(text).cast("string"), r"\n\z", "")
    lines = texts.select(*others, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    return lines.where(F.octet_length("line") <= most).withColumn("line", F.regexp_replace("line", r"\r\z", "")).where("line <> ''")


def lines_until_oversize(lines: DataFrame, key: str, most: int = LINE_BYTES) -> DataFrame:
    """The stricter rule: the first oversized line ends a file."""
    over = F.max((F.octet_length("line") > most).cast("int")).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("over", over).where("over = 0").drop("over")


@F.pandas_udf(T.BooleanType())
def _linked(path: pd.Series, root: pd.Series) -> pd.Series:
    """Whether a local path is a symbolic link, or lies behind one below the root. Other stores have no links."""

    def one(p: str, top: str) -> bool:
        local = re.sub("^file:(//)?", "", p) if p.startswith("file:") else ""
        while len(local) > len(top):
            if os.path.islink(local):
                return True
            local = os.path.dirname(local)
        return False

    return pd.Series([one(p, t) for p, t in zip(path, root, strict=True)], dtype=bool)


def listed(files: DataFrame, root: str) -> DataFrame:
    """session, project_dir, relative_path, is_subagent and the columns of ``files`` (path, modificationTime, length and others)
    that are session files under ``root``. Three layouts are told apart by what lies in it: a configuration folder with
    ``projects`` in it, one project's folder with logs (``*.jsonl``) right in it, or a folder of such project folders.

    A log's name is its session, and what lies in the folder of that name belongs to it, by its relative path. Symbolic links
    are left out, and files of over SIDECAR_BYTES that are neither logs nor logs of subagents. The layout is one row, told from
    names alone; links are looked for by the tasks that hold the names."""
    base = "/" + PurePosixPath(re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", root)).as_posix().strip("/")
    at = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    below = files.withColumn("rest_", F.substr(at, F.lit(len(base) + 2))).where(F.startswith(at, F.lit(base.rstrip("/") + "/")))
    below = below.where(~_linked("path", F.lit(base)))
    log = F.col("rest_").rlike(r"^[^/]+\.jsonl$")
    layout = below.agg(F.coalesce(F.max(F.startswith("rest_", F.lit("projects/"))), F.lit(False)).alias("config_"), F.coalesce(F.max(log), F.lit(False)).alias("single_"))
    name = F.lit(PurePosixPath(base).name)
    placed = below.crossJoin(F.broadcast(layout))
    under = F.when(F.col("config_"), F.regexp_extract("rest_", r"^projects/([^/]+/.+)$", 1)).when(F.col("single_"), F.concat(name, F.lit("/"), "rest_")).otherwise(F.col("rest_"))
    parts = placed.withColumn("under_", under).withColumn("project_dir", F.regexp_extract("under_", "^([^/]+)/", 1)).withColumn("inner_", F.regexp_extract("under_", "^[^/]+/(.+)$", 1))
    main = F.regexp_extract("inner_", r"^([^/]+)\.jsonl$", 1)
    made = parts.withColumn("session", F.coalesce(F.nullif(main, F.lit("")), F.regexp_extract("inner_", "^([^/]+)/", 1))).withColumn("relative_path", F.when(main != "", "").otherwise(F.regexp_extract("inner_", "^[^/]+/(.+)$", 1)))
    made = made.withColumn("is_subagent", F.col("relative_path").rlike(r"(^|/)subagents/agent-[^/]+\.jsonl$"))
    is_main = F.col("inner_").rlike(r"^[^/]+\.jsonl$")
    kept = made.where((F.col("session") != "") & (is_main | (F.col("relative_path") != "") & (F.col("is_subagent") | (F.col("length") <= SIDECAR_BYTES))))
    return kept.select("session", "project_dir", "relative_path", "is_subagent", *files.columns)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, session, project_dir, relative_path, is_subagent, mtime, size, content of the session files under ``root``, as in
    :func:`listed`: a log, and sidecars of sessions that have one. What is left out is so before its content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = listed(files, root)
    logs = listed(files.drop("content"), root).where("relative_path = ''").select("session", "project_dir").distinct()
    mine = found.join(logs, ["session", "project_dir"], "left_semi")
    return mine.select("path", "session", "project_dir", "relative_path", "is_subagent", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def guarded(spark: SparkSession, path: str, most: int) -> DataFrame:
    """text of whole files of at most ``most`` bytes; the size is tested before the content is read."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    return files.select("path", F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


def inside(path: str, root: str) -> bool:
    """Whether a path lies in a folder, links resolved."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return real == base or real.startswith(base + os.sep)


def safe_relative(path: Column) -> Column:
    """Relative, not empty, without any .. part."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike(r"^[A-Za-z]:")


def restore(files: DataFrame, target: str) -> int:
    """Write relative_path, content rows under ``target``, a folder that driver and executors share; returns how many. Each task
    writes its own rows, and one that runs again writes the same. Unsafe paths, paths that are there twice and links that lead
    out of the target raise; the former two before anything is written."""
    if bad := files.where(~safe_relative(F.col("relative_path"))).select("relative_path").first():
        raise ValueError(f"unsafe path {bad[0]!r}")
    if twice := files.groupBy("relative_path").count().where("count > 1").first():
        raise ValueError(f"{twice[0]!r} is there more than once")

    def write(batches):
        for batch in batches:
            for path, content in zip(batch["relative_path"], batch["content"], strict=True):
                to = os.path.join(target, *PurePosixPath(path).parts)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                if os.path.islink(to) or not inside(os.path.dirname(to), target):
                    raise ValueError(f"{path!r} leads out of the target")
                part = f"{to}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(bytes(content))
                os.replace(part, to)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("relative_path", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: A corpus of needles in haystacks.
FIXTURES = "id string, content_type string, haystack string, source_label string, source_kind string, cases array<struct<case_id string, query string, needles array<string>, expected_layer string, expected_rank_ceiling int>>"


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURES).json(path)


def manifest_hash(files: DataFrame) -> str:
    """sha256 over the contents of (path, content) in the order of names; the driver holds one partition's files at a time."""
    total = hashlib.sha256()
    for row in files.select("path", "content").orderBy("path").toLocalIterator():
        total.update(bytes(row.content))
    return total.hexdigest()


def by_path(files: DataFrame) -> DataFrame:
    return files.orderBy("relative_path")


def projects_root(root: str) -> str:
    """Where the session folders are: below a configuration folder its ``projects``, else the folder itself."""
    below = os.path.join(root, "projects")
    return below if os.path.isdir(below) else root


def report_metadata(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, git_sha, git_branch, dataset_hash, and the report's failures (case_id, type, expected, actual, detail)."""
    v = F.parse_json("value")
    raw = spark.read.option("wholetext", True).text(path).select(v.alias("v"))
    names = ("timestamp", "git_sha", "git_branch", "dataset_hash")
    failures = F.coalesce(F.try_variant_get("v", "$.failures", "array<struct<case_id:string,type:string,expected:string,actual:string,detail:string>>"), F.array())
    return raw.select(*[F.try_variant_get("v", f"$.metadata.{n}", "string").alias(n) for n in names], failures.alias("failures"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A quality report in long form: content_type (overall: null), metric, value."""
    raw = spark.read.option("multiLine", True).option("wholetext", True).text(path).select(F.parse_json("value").alias("v"))
    overall = raw.select(F.lit(None).cast("string").alias("content_type"), F.try_variant_get("v", "$.overall", "map<string,double>").alias("m"))
    parts = raw.select(F.explode(F.try_variant_get("v", "$.by_content_type", "map<string,map<string,double>>")).alias("content_type", "m"))
    return overall.unionByName(parts).select("content_type", F.explode("m").alias("metric", "value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
