"""Clauses by number: lookups, contexts, lead-ins, nested numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseflow.functions import text as T


def first_by_number(clauses: DataFrame) -> DataFrame:
    """(doc_id, number, ...): of clauses with one printed number in a document the first in order."""
    w = Window.partitionBy("doc_id", "number").orderBy("clause_index", "id")
    return clauses.filter("number IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def lookup(requests: DataFrame, clauses: DataFrame) -> DataFrame:
    """(request_id, clause_id, how): by printed number, Latin look-alikes read as Russian, else by clause id.

    requests: request_id, doc_id, wanted.
    """
    keyed = clauses.filter("number IS NOT NULL").withColumn("k", T.number_key("number"))
    w = Window.partitionBy("doc_id", "k").orderBy("clause_index", "id")
    first = keyed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("doc_id", "k", F.col("id").alias("by_number"))
    ids = clauses.select("doc_id", F.col("id").alias("wanted"), F.col("id").alias("by_id")).distinct()
    found = requests.withColumn("k", T.number_key("wanted")).join(first, ["doc_id", "k"], "left").join(ids, ["doc_id", "wanted"], "left")
    how = F.when(F.col("by_number").isNotNull(), "number").when(F.col("by_id").isNotNull(), "id").otherwise("none")
    return found.select("request_id", F.coalesce("by_number", "by_id").alias("clause_id"), how.alias("how"))


def prefix_closure(hits: DataFrame, clauses: DataFrame) -> DataFrame:
    """Ids of hit clauses and of all clauses of the same document whose number lies below a hit's number.

    hits: (doc_id, id, number). A number's ancestors are exploded, so that 'starts with' is an equality join.
    """
    below = clauses.filter("number IS NOT NULL").select("doc_id", "id", F.explode(T.number_ancestors("number")).alias("number"))
    under = below.join(hits.select("doc_id", "number").filter("number IS NOT NULL").distinct(), ["doc_id", "number"], "left_semi").select("doc_id", "id")
    return hits.select("doc_id", "id").unionByName(under).distinct()


def ancestor_labels(clauses: DataFrame, longest: int = 200) -> DataFrame:
    """(id, path): the section and the labels ('number. text', cut) of a clause's ancestors in the same section, outermost first."""
    first = first_by_number(clauses).select("doc_id", "number", "section", F.substring(F.concat_ws(". ", "number", "text"), 1, longest).alias("label"))
    up = clauses.select("doc_id", "id", "section", F.posexplode_outer(T.number_ancestors(F.coalesce("number", F.lit("")))).alias("level", "number"))
    found = up.join(first, ["doc_id", "number", "section"], "left")
    path = F.transform(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("level", "label")))), lambda x: x["label"])
    return found.groupBy("id").agg(F.max("section").alias("section"), path.alias("labels")).select("id", F.concat(F.array("section"), "labels").alias("path"))


def lead_in_chain(clauses: DataFrame) -> DataFrame:
    """(id, lead_in_chain): labels of the unbroken run of ancestors that end in a colon, from the outermost to the parent; null without one."""
    first = first_by_number(clauses).select("doc_id", "number", "section", F.concat_ws(". ", "number", "text").alias("label"), F.col("text").rlike(r":\s*$").alias("colon"))
    up = clauses.filter("number IS NOT NULL").select("doc_id", "id", "section", F.posexplode(T.number_ancestors("number")).alias("level", "number"))
    found = up.join(first, ["doc_id", "number", "section"], "left").withColumn("colon", F.coalesce("colon", F.lit(False)))
    w = Window.partitionBy("id").orderBy(F.desc("level"))
    open_ = found.withColumn("broken", F.max((~F.col("colon")).cast("int")).over(w)).filter("broken = 0")
    chain = open_.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "label"))), lambda x: x["label"]), " ").alias("lead_in_chain"))
    return clauses.select("id").distinct().join(chain, "id", "left")
