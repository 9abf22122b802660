"""Stored answers and vectors as tables: JSON files under content keys, joined instead of asked for.

Answers: {folder}/{call}/{key}.json, key the payload's (operators.report.payload_key). Vectors: {folder}/{sha256 of text}.json with
model, text_sha256 and vector. No executor ever calls a service; a missing answer is a null.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.functions import text as T


def read_answers(spark: SparkSession, folder: str, call: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(answers: key + `schema`, rejects: key, raw, reason). A field too many, one missing or a wrong type rejects an answer."""
    raw = spark.read.text(f"{folder}/{call}/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("key"), F.col("value").alias("raw"))
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    parsed = raw.withColumn("a", F.from_json("raw", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("names", F.json_object_keys("raw"))
    same = F.size(F.array_except("names", F.lit(fields))) + F.size(F.array_except(F.lit(fields), F.col("names")))
    reason = F.when(F.col("names").isNull(), "no JSON object").when(same != 0, "fields").when(F.col("a._bad").isNotNull(), "type")
    judged = parsed.withColumn("reason", reason)
    return judged.filter("reason IS NULL").select("key", *[F.col(f"a.{f}").alias(f) for f in fields]), judged.filter("reason IS NOT NULL").select("key", "raw", "reason")


def write_answers(answers: DataFrame, folder: str, call: str) -> None:
    """Appends answers (key, and the fields) as JSON lines beside earlier ones, for a later run's lookup table."""
    answers.write.mode("append").json(f"{folder}/{call}-lines")


def read_recorded(spark: SparkSession, folder: str, call: str, schema: str) -> DataFrame:
    """Answers appended by `write_answers`, one a key: the last in order of their fields where a key was answered several times."""
    rows = spark.read.schema(f"key string, {schema}").json(f"{folder}/{call}-lines").filter("key IS NOT NULL")
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max(F.struct(*rest)).alias("a")).select("key", "a.*")


def all_answers(spark: SparkSession, folder: str, call: str, schema: str) -> DataFrame:
    """Stored answers, with the recorded ones in place of those of the same key."""
    recorded = read_recorded(spark, folder, call, schema)
    stored = read_answers(spark, folder, call, schema)[0]
    return stored.join(recorded, "key", "left_anti").unionByName(recorded)


def write_vectors(df: DataFrame, folder: str, model: str) -> None:
    """Appends vectors (text, vector) of a model as JSON lines under the hash of their text; rows without a vector are left out."""
    rows = df.filter("text IS NOT NULL AND size(vector) > 0").select(F.lit(model).alias("model"), T.text_sha256("text").alias("text_sha256"), F.col("vector").cast("array<double>").alias("vector"))
    rows.distinct().write.mode("append").json(f"{folder}/lines")


def recorded_vectors(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """(text_sha256, vector) of what `write_vectors` stored for a model, one a text."""
    rows = spark.read.schema("model string, text_sha256 string, vector array<double>").json(f"{folder}/lines")
    return rows.filter(F.col("model") == model).groupBy("text_sha256").agg(F.min("vector").alias("vector"))


def strict_schema(df_schema) -> dict:
    """A struct type as a JSON schema that allows no other fields and asks for all of its own."""
    kind = df_schema.typeName()
    if kind == "struct":
        return {"type": "object", "properties": {f.name: strict_schema(f.dataType) for f in df_schema.fields}, "required": [f.name for f in df_schema.fields], "additionalProperties": False}
    if kind == "array":
        return {"type": "array", "items": strict_schema(df_schema.elementType)}
    names = {"string": "string", "boolean": "boolean", "long": "integer", "integer": "integer", "short": "integer", "double": "number", "float": "number"}
    return {"type": names.get(kind, "string")}


def read_vectors(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """(text_sha256, vector) of one model; files whose name isn't the hash they state are left out."""
    rows = spark.read.schema("model string, text_sha256 string, vector array<double>").json(f"{folder}/*.json", multiLine=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.filter((F.col("model") == model) & (F.col("name") == F.col("text_sha256")) & (F.size("vector") > 0)).select("text_sha256", "vector")


def with_vectors(df: DataFrame, vectors: DataFrame, text_col: str = "text") -> DataFrame:
    """df with `vector` of its text, null where none is stored."""
    return df.withColumn("text_sha256", T.text_sha256(text_col)).join(vectors, "text_sha256", "left").drop("text_sha256")


def put_run(spark: SparkSession, folder: str, run_id: str, status: dict, report: DataFrame | None = None) -> None:
    """Stores a run: its status as one JSON line, replaced as a whole, and its report."""
    spark.createDataFrame([(json.dumps(status, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{run_id}/status")
    if report is not None:
        report.write.mode("overwrite").json(f"{folder}/{run_id}/report")


def get_run(spark: SparkSession, folder: str, run_id: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{run_id}/status").first()[0])
