"""Decisions on pairs of functions: verdicts, call budget, exact links, groups of links and their status, degree caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.session import Shelf


def with_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str], order: list[Column], answer: str) -> DataFrame:
    """rows left-joined to the last verdict of each key; no verdict gives null and answered = false."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = verdicts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, answer)
    return rows.join(last, keys, "left").withColumn("answered", F.col(answer).isNotNull())


def running_total(df: DataFrame, order: str, tie: str, demand: str) -> DataFrame:
    """df with `before`, the sum of `demand` over all rows ahead in (order, tie).

    One global order without one task for all rows: rows are spread by ranges of (order, tie), as many as the session's shuffles have, and
    written; ranges are totalled (a row each), and rows are only summed within their range. Null order keys come first.
    """
    key = [F.asc_nulls_first(order), F.asc(tie)]
    rows = Shelf(df.sparkSession, "running").put(df.repartitionByRange(*key).withColumn("_b", F.spark_partition_id()))
    sums = rows.groupBy("_b").agg(F.sum(demand).alias("_s"))
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    within = Window.partitionBy("_b").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(ahead), "_b").withColumn("before", F.col("_ahead") + F.coalesce(F.sum(demand).over(within), F.lit(0))).drop("_b", "_ahead")  # one row a range


def call_budget(df: DataFrame, order: str, tie: str, demand: str, limit: int) -> DataFrame:
    """df with `before` and `allowed`: whether a row's calls fit into what rows ahead of it left of the limit; a row without calls is free."""
    return running_total(df, order, tie, demand).withColumn("allowed", (F.col(demand) == 0) | (F.col("before") + F.col(demand) <= limit))


def exact_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_id, after_id, decision): equal normalised text and modality decide without a verdict.

    Same owner: the n-th of several equal ones is kept with the n-th of the other side, in order of id. What is left goes
    to another known owner, 'moved', where exactly one such candidate of the text remains for exactly one function.
    before, after: id, text, modality, unit_id; a null unit is no owner.
    """
    b = before.select(F.col("id").alias("before_id"), T.normalize_text("text").alias("key"), "modality", "unit_id").filter("key <> ''")
    a = after.select(F.col("id").alias("after_id"), T.normalize_text("text").alias("key"), "modality", "unit_id").filter("key <> ''")
    same = ["key", "modality", "unit_id"]
    nth = lambda df, i: df.filter("unit_id IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(i)))
    kept = nth(b, "before_id").join(nth(a, "after_id"), [*same, "nth"]).select("before_id", "after_id", F.lit("kept").alias("decision"))
    one = lambda df, done, i: df.join(done, i, "left_anti").filter("unit_id IS NOT NULL").groupBy("key", "modality").agg(F.count("*").alias("n"), F.min(i).alias(i)).filter("n = 1").drop("n")
    moved = one(b, kept, "before_id").join(one(a, kept, "after_id"), ["key", "modality"]).select("before_id", "after_id", F.lit("moved").alias("decision"))
    return kept.unionByName(moved)


def group_summary(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per group of links: sides, decisions, kind, status and least confidence.

    members: (group_id, member_id, version); links: (group_id, decision, verification, confidence).
    """
    sides = members.groupBy("group_id").agg(F.count(F.when(F.col("version") == "before", 1)).alias("n_before"), F.count(F.when(F.col("version") == "after", 1)).alias("n_after"))
    said = links.groupBy("group_id").agg(
        F.max((F.col("decision") == "partial").cast("int")).alias("partial"),
        F.max((F.col("decision") == "merge").cast("int")).alias("merge"),
        F.min("decision").alias("decision"),
        F.min(F.col("verification") == "exact").alias("exact"),
        F.min("confidence").alias("confidence"),
    )
    kind = F.when(F.col("n_before") > 1, "merge").when(F.col("partial") == 1, "partial").when(F.col("n_after") > 1, "split").when(F.col("merge") == 1, "merge").otherwise("one_to_one")
    status = F.when(kind != "one_to_one", "changed").when(F.col("decision") == "split", "changed").otherwise(F.col("decision"))
    return sides.join(said, "group_id").select("group_id", "n_before", "n_after", kind.alias("kind"), status.alias("status"), F.when(F.col("exact"), "exact").otherwise("llm").alias("verification"), "confidence")


def owner_relation(before_unit: Column, after_unit: Column, lineage: Column, before_executor: Column, after_executor: Column) -> Column:
    """same / transformed / different / unknown; lineage is the status of the pair of units, null if they were not paired."""
    eb, ea = T.normalize_text(before_executor), T.normalize_text(after_executor)
    return (
        F.when(before_unit == after_unit, "same")
        .when(lineage == "kept", "same")
        .when(lineage.isNotNull(), "transformed")
        .when(before_unit.isNotNull() & after_unit.isNotNull(), "different")
        .when((eb == ea) & ((eb != "") | (before_unit.isNull() & after_unit.isNull())), "same")
        .otherwise("unknown")
    )


def degree_cap(pairs: DataFrame, cap: int = 5) -> DataFrame:
    """The pairs that a pass in order of (similarity desc, a, b) accepts when no end may have more than `cap` pairs.

    pairs: (a, b, similarity), a <> b. Decided in parallel rounds with the result of the sequential pass: a pair is accepted once, at both ends,
    fewer than `cap` pairs ahead of it are accepted or open; it is rejected once `cap` pairs ahead of it are accepted at one end.
    The first open pair is always decided, so rounds end; in practice a few suffice.
    """
    shelf = Shelf(pairs.sparkSession, "degree-cap")
    state = shelf.put(pairs.select("a", "b", "similarity").distinct().withColumn("s", F.lit(None).cast("int")))  # 1 accepted, 0 rejected
    while True:
        ends = state.select(F.inline(F.array(F.struct(F.col("a").alias("e"), "a", "b", "similarity", "s"), F.struct(F.col("b").alias("e"), "a", "b", "similarity", "s"))))
        w = Window.partitionBy("e").orderBy(F.desc("similarity"), "a", "b").rowsBetween(Window.unboundedPreceding, -1)
        seen = ends.select("a", "b", "similarity", "s", F.coalesce(F.sum((F.col("s") == 1).cast("int")).over(w), F.lit(0)).alias("yes"), F.coalesce(F.sum(F.col("s").isNull().cast("int")).over(w), F.lit(0)).alias("open"))
        both = seen.groupBy("a", "b", "similarity").agg(F.max("s").alias("s"), F.max("yes").alias("yes"), F.max(F.col("yes") + F.col("open")).alias("most"))
        new = F.when(F.col("s").isNotNull(), F.col("s")).when(F.col("yes") >= cap, 0).when(F.col("most") < cap, 1)
        step = shelf.put(both.select("a", "b", "similarity", new.cast("int").alias("s")))
        shelf.drop(state)
        state = step
        if state.filter("s IS NULL").limit(1).count() == 0:
            return state.filter("s = 1").drop("s")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, in the given order; null if none does."""
    out = None
    for name, hit in reasons:
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def most_specific(findings: DataFrame, key: str, rule: str, order: list[str]) -> DataFrame:
    """Of the findings on one key the one whose rule comes first in `order`."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(rule))
    w = Window.partitionBy(key).orderBy(F.when(rank > 0, rank).otherwise(len(order) + 1), rule)
    return findings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
