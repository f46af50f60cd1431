"""What the jobs share: settings from a config file and the command line, read and written by Spark alone."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

S = TypeVar("S")


def settings(spark: SparkSession, kind: type[S], config: str | None, given: dict[str, Any]) -> S:
    """Defaults of ``kind``, over them the config file's values (JSON, of any path that Spark reads), over them ``given``."""
    found = json.loads(spark.read.text(config, wholetext=True).first()[0]) if config else {}
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(found) - names:
        raise ValueError(f"{config}: unknown settings {sorted(unknown)}")
    found = {k: tuple(map(tuple, v)) if isinstance(v, list) else v for k, v in found.items()}
    return kind(**found | {k: v for k, v in given.items() if v is not None})


def empty_if_missing(like: DataFrame, path: str, *partitions: str) -> None:
    """A table of no rows where none stands yet, so that it can be read before anything is written."""
    like.limit(0).write.mode("ignore").partitionBy(*partitions).parquet(path)


def main(kind: type[S], run: Callable[[SparkSession, S], Any], about: str) -> None:
    """The command line: --config, and an option for each text setting."""
    args = argparse.ArgumentParser(description=about)
    args.add_argument("--config")
    for f in dataclasses.fields(kind):
        if f.type in ("str", str):
            args.add_argument(f"--{f.name.replace('_', '-')}")
    given = vars(args.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, settings(spark, kind, given.pop("config"), given))
    finally:
        spark.stop()
