"""Readers of the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of a data folder; a table may be one file or a folder of files.

    With columns, only those are read, and rows are spread evenly, over as many parts as the table has files' parts, at least one a core:
    for work on texts that costs far more than moving them (some hundred CPU seconds a GB against some ten), where one file of long
    texts would else hold up a stage.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not columns:
        return df
    df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(max(cores, parts))


def document_pair(spark: SparkSession, sf_dir: str, kind: str = "polozhenie") -> tuple[DataFrame, DataFrame]:
    """The clauses of all regulations of a kind, 'before' and 'after': a fixed input to try a comparison on."""
    docs = table(spark, sf_dir, "regulations").filter(F.col("kind") == kind).select(F.col("id").alias("doc_id"), "version")
    clauses = table(spark, sf_dir, "clauses").drop("loaded_at").distinct().join(docs, "doc_id")
    return clauses.filter("version = 'before'"), clauses.filter("version = 'after'")
