"""A training corpus from ``documents``: toxic documents go, frequent lines go, one document of each near-duplicate group
stays, documents that hold benchmark passages go, and what is left is packed into sequences.

Odd rows: a null text is the empty one, and an empty text is clean, keeps its one empty line, and is a near copy only of texts
that have no words either; of rows with a null doc_id each stage keeps or drops each by its text, and of near copies one with
an id stays before one without. Repeated rows are near copies. An empty table gives an empty one. Columns beyond
those of documents pass through all stages but the last, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import decontamination, lines, packing, simhash, toxicity
from lexspark.llm.common import table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(docs, mode="all", min_docs=10).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, radius=2)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, size=1024)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("simhash", _simhash), ("decontamination", _decontamination), ("packing", _packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn weights, follow links and tokenise: SQL can't express them.
ORACLE_SQL = None
