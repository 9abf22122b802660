"""Decisions end to end: checked verdicts, components with their status, losses, new functions, duplicates, the gate on sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.operators import matching

# Confidence of a decision.
CONFIDENCE = {"exact": 1.0, "exact_moved": 0.9, "kept": 0.9, "moved": 0.9, "changed": 0.8, "split": 0.8, "merge": 0.8, "partial": 0.6, "lost": 0.85, "new": 0.7, "unverified": 0.4}


def _confidence(decision) -> Column:
    return F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[decision]


def checked_verdicts(verdicts: DataFrame, shown: DataFrame, texts: DataFrame) -> DataFrame:
    """(before_id, outcome, decision, after_ids, verification, confidence): what a stored verdict on a function comes to.

    verdicts: before_id, after_ids, decision, one row a function; shown: (before_id, after_id), the candidates that were asked about;
    texts: id, text. Ids that weren't shown and repeats fall out, the order stays. outcome: link; none ('no candidate fits'); failure (no
    verdict, or a decision without a shown id). A single id with the same key and 'kept' is exact.
    """
    asked = shown.select("before_id", "after_id").distinct()
    given = verdicts.select("before_id", "decision", F.posexplode_outer("after_ids").alias("place", "after_id"))
    key = texts.select(F.col("id").alias("x"), T.normalize_text("text").alias("k")).distinct()
    ok = (
        given.join(asked, ["before_id", "after_id"], "left_semi")
        .groupBy("before_id", "after_id").agg(F.min("place").alias("place"))
        .join(key.select(F.col("x").alias("before_id"), F.col("k").alias("kb")), "before_id", "left")
        .join(key.select(F.col("x").alias("after_id"), F.col("k").alias("ka")), "after_id", "left")
        .groupBy("before_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "after_id"))), lambda s: s["after_id"]).alias("after_ids"), F.min(F.col("kb").eqNullSafe(F.col("ka"))).alias("same"))
    )
    every = asked.select("before_id").distinct().join(verdicts.select("before_id", "decision").distinct(), "before_id", "left").join(ok, "before_id", "left")
    outcome = F.when(F.col("decision").isNull(), "failure").when(F.col("decision") == "none", "none").when(F.col("after_ids").isNull(), "failure").otherwise("link")
    exact = (F.col("decision") == "kept") & (F.size("after_ids") == 1) & F.col("same")
    out = every.withColumn("outcome", outcome).withColumn("verification", F.when(F.col("outcome") == "link", F.when(exact, "exact").otherwise("llm")))
    conf = F.when(F.col("verification") == "exact", F.lit(CONFIDENCE["exact"])).when(F.col("outcome") == "link", _confidence(F.col("decision")))
    ids = F.when(F.col("outcome") == "link", F.col("after_ids"))
    return out.select("before_id", "outcome", "decision", ids.alias("after_ids"), "verification", conf.alias("confidence"))


def assignment(relations: DataFrame, executors: DataFrame) -> DataFrame:
    """(group_id, assignment): moved, transformed, executor (other performers), unknown or same.

    relations: (group_id, relation) of pairs of functions of a group; executors: (group_id, version, executor) of its members.
    """
    rel = relations.groupBy("group_id").agg(*[F.max((F.col("relation") == r).cast("int")).alias(r) for r in ("different", "transformed", "same", "unknown")])
    who = executors.filter(F.coalesce("executor", F.lit("")) != "").select("group_id", "version", T.normalize_text("executor").alias("e"))
    side = lambda v: F.array_sort(F.collect_set(F.when(F.col("version") == v, F.col("e")))).alias(v)
    both = who.groupBy("group_id").agg(side("before"), side("after"))
    other = (F.size("before") > 0) & (F.size("after") > 0) & (F.col("before") != F.col("after"))
    code = (
        F.when(F.col("different") == 1, "moved").when(F.col("transformed") == 1, "transformed").when(F.coalesce(other, F.lit(False)), "executor")
        .when((F.col("unknown") == 1) & (F.col("same") == 0), "unknown").otherwise("same")
    )
    return rel.join(both, "group_id", "left").select("group_id", code.alias("assignment"))


def component_summary(members: DataFrame, links: DataFrame, assigned: DataFrame) -> DataFrame:
    """(group_id, n_before, n_after, kind, status, assignment, verification, confidence) of components of links.

    members: (group_id, member_id, version); links: (group_id, place, decision, verification, confidence), the first link by place decides a
    one-to-one component; assigned: the result of `assignment`. 'moved' to the same or a transformed owner is 'changed'; 'kept' or
    'changed' at another owner is 'moved'.
    """
    n = lambda v: F.count(F.when(F.col("version") == v, 1)).alias(f"n_{v}")
    sides = members.groupBy("group_id").agg(n("before"), n("after"))
    said = links.groupBy("group_id").agg(
        F.min_by("decision", "place").alias("first"), F.collect_set("decision").alias("all"), F.min(F.col("verification") == "exact").alias("exact"), F.min("confidence").alias("confidence")
    )
    has = lambda d: F.array_contains("all", d)
    kind = F.when(F.col("n_before") > 1, "merge").when(has("partial"), "partial").when(F.col("n_after") > 1, "split").when(has("merge"), "merge").otherwise("one_to_one")
    rows = sides.join(said, "group_id").join(assigned, "group_id", "left").withColumn("kind", kind)
    first = F.when(F.col("first") == "split", "changed").otherwise(F.col("first"))
    status = (
        F.when(F.col("kind") != "one_to_one", "changed")
        .when((first == "moved") & F.col("assignment").isin("same", "transformed", "executor"), "changed")
        .when(first.isin("kept", "changed") & (F.col("assignment") == "moved"), "moved")
        .otherwise(first)
    )
    return rows.select("group_id", "n_before", "n_after", "kind", status.alias("status"), "assignment", F.when(F.col("exact"), "exact").otherwise("llm").alias("verification"), "confidence")


def confirmed_losses(losses: DataFrame, shown: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(before_id, status, verified, confidence, why): a function is lost if a verdict says so and names, if any, a clause that was shown.

    losses: before_id; shown: (before_id, number) of the nearest clauses and functions; verdicts: (before_id, lost, nearest_number). All
    others are candidates for a loss, with the reason.
    """
    number = F.nullif(F.trim("nearest_number"), F.lit(""))
    v = verdicts.withColumn("number", number)
    ok = v.join(shown.select("before_id", "number").distinct().withColumn("there", F.lit(True)), ["before_id", "number"], "left")
    rows = losses.select("before_id").distinct().join(ok, "before_id", "left")
    why = F.when(F.col("lost").isNull(), "no verdict").when(F.col("number").isNotNull() & F.col("there").isNull(), "clause not shown").when(~F.col("lost"), "not confirmed")
    good = why.isNull()
    return rows.select("before_id", F.lit("lost").alias("status"), good.alias("verified"), F.when(good, CONFIDENCE["lost"]).otherwise(CONFIDENCE["unverified"]).alias("confidence"), why.alias("why"))


def new_functions(after: DataFrame, linked: DataFrame, nearest: DataFrame, reviews: DataFrame) -> DataFrame:
    """(after_id, verified, verification, confidence): functions of 'after' without a link.

    linked: after_id; nearest: (after_id, before_id), the best of the reverse search; reviews: (before_id, after_id, how), the candidates that a
    decided function was shown with, how 'exact' or 'llm'. A new function is verified if nothing like it was found, or its nearest one was
    decided in its presence.
    """
    rows = after.select("after_id").distinct().join(linked.select("after_id").distinct(), "after_id", "left_anti").join(nearest.select("after_id", "before_id").distinct(), "after_id", "left")
    rows = rows.join(reviews.groupBy("before_id", "after_id").agg(F.max("how").alias("how")), ["before_id", "after_id"], "left")
    verified = F.col("before_id").isNull() | F.col("how").isNotNull()
    return rows.select("after_id", verified.alias("verified"), F.when(F.col("how") == "llm", "llm").otherwise("lexical").alias("verification"), F.when(verified, CONFIDENCE["new"]).otherwise(CONFIDENCE["unverified"]).alias("confidence"))


def every_function_once(functions: DataFrame, components: DataFrame, members: DataFrame, new: DataFrame, lost: DataFrame) -> DataFrame:
    """(id, version, status, verified): every function in exactly one finding: its component's, new, lost, or a candidate without a decision."""
    of = members.select(F.col("member_id").alias("id"), "group_id").join(components.select("group_id", "status"), "group_id").groupBy("id").agg(F.min("status").alias("of"))
    rows = functions.select("id", "version").distinct().join(of, "id", "left")
    rows = rows.join(new.select(F.col("after_id").alias("id"), F.col("verified").alias("n")), "id", "left").join(lost.select(F.col("before_id").alias("id"), F.col("verified").alias("l")), "id", "left")
    status = F.when(F.col("of").isNotNull(), F.col("of")).when(F.col("version") == "after", "new").otherwise("lost")
    verified = F.when(F.col("of").isNotNull(), True).when(F.col("version") == "after", F.coalesce("n", F.lit(False))).otherwise(F.coalesce("l", F.lit(False)))
    return rows.select("id", "version", status.alias("status"), verified.alias("verified"))


def consistent_answer(is_duplicate, same_action, same_object, both_executors) -> Column:
    """Whether an answer on a pair holds together: a duplicate has all three marks."""
    return ~F.coalesce(is_duplicate, F.lit(False)) | (F.coalesce(same_action, F.lit(False)) & F.coalesce(same_object, F.lit(False)) & F.coalesce(both_executors, F.lit(False)))


def consistent_pair(status, before, after) -> Column:
    """Whether a change of units fits its sides: created has no 'before', abolished no 'after', the rest both."""
    return F.when(status == "created", before.isNull() & after.isNotNull()).when(status == "abolished", before.isNotNull() & after.isNull()).otherwise(before.isNotNull() & after.isNotNull())


def find_duplicates(pairs: DataFrame, verdicts: DataFrame, cap: int = 5, limit: int = 200) -> DataFrame:
    """(a, b, similarity, verified, place): pairs after the cap on degrees, the budget of verdicts and the verdicts themselves.

    pairs: (a, b, similarity); verdicts: (a, b, is_duplicate, same_action, same_object, both_executors). A pair that a consistent verdict denies is
    none; without a verdict, with an inconsistent one, or beyond the budget, it stays a candidate. Confirmed ones come first.
    """
    kept = matching.degree_cap(pairs, cap).withColumn("calls", F.lit(1)).withColumn("order", -F.col("similarity")).withColumn("tie", F.struct("a", "b"))
    asked = matching.call_budget(kept, "order", "tie", "calls", limit)
    v = asked.join(verdicts, ["a", "b"], "left")
    sound = consistent_answer(*[F.col(c) for c in ("is_duplicate", "same_action", "same_object", "both_executors")]) & F.col("is_duplicate").isNotNull() & F.col("allowed")
    out = v.withColumn("verified", F.coalesce(sound & F.col("is_duplicate"), F.lit(False))).filter(~F.coalesce(sound & ~F.col("is_duplicate"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("verified").orderBy(F.desc("similarity"), "a", "b"))
    return out.select("a", "b", "similarity", "verified", place.alias("place"))


def valid_sources(citations: DataFrame, clauses: DataFrame, documents: DataFrame, checked: DataFrame) -> DataFrame:
    """citations (citation_id, owner_kind, owner_id, doc_id, version) with `ok`: the citation holds and its version is its document's.

    checked: the result of provenance.check_citations; documents: id, version.
    """
    c = citations.select("citation_id", "owner_kind", "owner_id", "doc_id", "version").distinct()
    d = documents.select(F.col("id").alias("doc_id"), "version").distinct().withColumn("_there", F.lit(True))
    rows = c.join(d, ["doc_id", "version"], "left").join(checked, "citation_id", "left")
    return rows.select("citation_id", "owner_kind", "owner_id", "doc_id", "version", (F.col("_there").isNotNull() & (F.coalesce("status", F.lit("")) == "ok")).alias("ok"))


def gated(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """(finding_id, n_sides, n_held, kept): a finding stays if each of its sides has a valid source of its own version.

    findings: (finding_id, side_kind, side_id, side_version), one row a side; a side_version of null takes sources of any version. sources: the result of
    `valid_sources`.
    """
    good = sources.filter("ok").select(F.col("owner_kind").alias("side_kind"), F.col("owner_id").alias("side_id"), F.col("version").alias("v")).distinct()
    sides = findings.select("finding_id", "side_kind", "side_id", "side_version").distinct()
    held = sides.join(good, ["side_kind", "side_id"]).filter("side_version IS NULL OR side_version = v").select("finding_id", "side_kind", "side_id").distinct()
    n = held.groupBy("finding_id").agg(F.count("*").alias("n_held"))
    total = sides.select("finding_id", "side_kind", "side_id").distinct().groupBy("finding_id").agg(F.count("*").alias("n_sides"))
    out = total.join(n, "finding_id", "left").select("finding_id", "n_sides", F.coalesce("n_held", F.lit(0)).alias("n_held"))
    return out.withColumn("kept", F.col("n_held") == F.col("n_sides"))


# -- the conclusion


def references(text) -> Column:
    """Findings that a paragraph refers to: distinct F-numbers in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(F\d+)\]"), F.lit(1)))


def admitted_paragraphs(paragraphs: DataFrame, known: Column, unverified: Column, mark: str = "требует проверки") -> DataFrame:
    """paragraphs (text) that refer to known findings only, to one at least, and say so where one isn't verified. known, unverified: arrays."""
    refs = references(F.col("text"))
    ok = (F.size(refs) > 0) & (F.size(F.array_except(refs, known)) == 0) & (~F.arrays_overlap(refs, unverified) | F.contains(F.lower("text"), F.lit(mark)))
    return paragraphs.filter(ok)


def admitted_recommendations(recommendations: DataFrame, verified: Column) -> DataFrame:
    """recommendations (text) that refer to verified findings only, and to one at least."""
    refs = references(F.col("text"))
    return recommendations.filter((F.size(refs) > 0) & (F.size(F.array_except(refs, verified)) == 0))


def explanation(rule, quotes) -> Column:
    """A finding in words: the rule's name and the quotes it rests on."""
    return F.concat(rule, F.lit(": "), F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("«"), q, F.lit("»"))), "; "))
