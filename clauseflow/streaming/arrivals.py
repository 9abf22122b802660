"""Arriving rows as a stream: repeats dropped, event-time windows, written batch by batch."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.session import Shelf


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the parquet files under a path (or of the one file it names)."""
    schema = spark.read.parquet(path).schema
    local = urlparse(path).path
    if os.path.isfile(local):
        folder, name = os.path.split(path)
        return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_counts(spark: SparkSession, path: str, time_col: str, id_col: str, delay: str = "3650 days") -> DataFrame:
    """(day, n): rows per day of `time_col`, each (id, time) once; rows later than `delay` behind the newest are dropped.

    Runs the stream over what is there (trigger availableNow) and returns the written table.
    """
    shelf = Shelf(spark, "stream")
    rows = read_files(spark, path).select(F.col(time_col).cast("timestamp").alias("at"), F.col(id_col).alias("id")).filter("at IS NOT NULL AND id IS NOT NULL")
    once = rows.withWatermark("at", delay).dropDuplicates(["id", "at"])
    counts = once.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    out = f"{shelf.base}/out"

    def write(batch: DataFrame, _no: int) -> None:  # the whole result each time: a repeated batch writes the same
        batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n").write.mode("overwrite").parquet(out)

    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{shelf.base}/log").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema("day string, n long").parquet(out)
