"""Queries of decisions, mentions, owners, the gate on sources and the report's counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.operators import decisions, hierarchy, matching, mentions, performers, provenance, report, units
from clauseflow.plans.queries import _components, asked, citation_rows, clause_rows, functions, link_pairs, link_rows, owner_relation, query, unit_rows
from clauseflow.session import Shelf
from clauseflow.sources.tables import table


def _links(spark, d):
    """Links that say something, with a place: the order in which the first one decides."""
    rows = link_rows(spark, d).filter("before_id IS NOT NULL AND decision <> 'none'")
    return rows.withColumn("place", F.struct("before_id", F.coalesce(F.array_join("after_ids", ",", "?"), F.lit("")).alias("ids"), "decision", "verification", F.coalesce("confidence", F.lit(-1.0)).alias("c")))


def _members(spark, d, labels):
    f = functions(spark, d).select(F.col("id").alias("node"), "version", "executor").distinct()
    return labels.join(f, "node").select(F.col("label").alias("group_id"), F.col("node").alias("member_id"), "version", "executor")


def _assigned(spark, d, labels, members):
    rel = owner_relation(spark, d).join(labels.withColumnRenamed("node", "before_id"), "before_id").select(F.col("label").alias("group_id"), "relation")
    return decisions.assignment(rel, members)


def _summary(spark, d):
    shelf = Shelf(spark, "components")
    labels = shelf.put(_components(spark, d))
    members = shelf.put(_members(spark, d, labels))
    links = _links(spark, d).join(labels.withColumnRenamed("node", "before_id"), "before_id").select(F.col("label").alias("group_id"), "place", "decision", "verification", "confidence")
    return decisions.component_summary(members.select("group_id", "member_id", "version").distinct(), links, _assigned(spark, d, labels, members)), members


@query
def component_summary(spark, d):
    """Kind, status and confidence of each group of linked functions; the first link decides, changes of owners correct it."""
    return _summary(spark, d)[0]


@query
def assignment_summary(spark, d):
    labels = Shelf(spark, "assignment").put(_components(spark, d))
    return _assigned(spark, d, labels, _members(spark, d, labels))


def _last_verdicts(spark, d):
    v = table(spark, d, "links").filter("before_id IS NOT NULL").select("before_id", "after_ids", "decision", "loaded_at", "recorded_at")
    return v.groupBy("before_id").agg(F.max(F.struct("loaded_at", "recorded_at", "decision", "after_ids")).alias("v")).select("before_id", "v.after_ids", "v.decision")


@query
def verified_links(spark, d):
    """The last verdict on each function, checked against the functions of 'after' that any verdict on it was asked about."""
    f = functions(spark, d)
    after = f.filter("version = 'after'").select(F.col("id").alias("after_id")).distinct()
    shown = link_pairs(spark, d).join(after, "after_id", "left_semi")
    out = decisions.checked_verdicts(_last_verdicts(spark, d), shown, f.select("id", "text"))
    return out.select("before_id", "outcome", "decision", F.array_join("after_ids", ",").alias("after_ids"), "verification", "confidence")


@query
def every_function_once(spark, d):
    """Counts of functions by version, status and whether that was verified: each function is in exactly one finding."""
    components, members = _summary(spark, d)
    f = functions(spark, d).filter("modality <> 'prohibition'")
    said = link_rows(spark, d).filter("before_id IS NOT NULL AND decision = 'none'").select("before_id").distinct().withColumn("verified", F.lit(True))
    linked = link_pairs(spark, d).select("after_id")
    none = spark.createDataFrame([], "after_id string, before_id string, how string")
    new = decisions.new_functions(f.filter("version = 'after'").select(F.col("id").alias("after_id")), linked, none.select("after_id", "before_id"), none.select("before_id", "after_id", "how"))
    out = decisions.every_function_once(f, components, members.select("member_id", "group_id").distinct(), new, said)
    return out.groupBy("version", "status", "verified").agg(F.count("*").alias("n"))


@query
def finding_gate(spark, d):
    """Linked pairs of functions, each side of which must have a valid source of its own version."""
    c = citation_rows(spark, d)
    checked = provenance.check_citations(c, clause_rows(spark, d))
    sources = decisions.valid_sources(c, clause_rows(spark, d), table(spark, d, "regulations"), checked)
    p = link_pairs(spark, d).withColumn("finding_id", F.concat_ws("-", "before_id", "after_id"))
    side = lambda col, v: p.select("finding_id", F.lit("function").alias("side_kind"), F.col(col).alias("side_id"), F.lit(v).alias("side_version"))
    return decisions.gated(side("before_id", "before").unionByName(side("after_id", "after")), sources)


@query
def conclusion_sources(spark, d):
    """Citations that a conclusion may print: name, version and number are the document's and clause's, and the quote is in the clause's own text."""
    c = citation_rows(spark, d).select("owner_kind", "owner_id", "doc_id", "doc_name", "version", "clause_id", "clause_number", "quote").distinct()
    r = table(spark, d, "regulations").select(F.col("id").alias("doc_id"), F.col("name").alias("doc_name"), "version")
    t = clause_rows(spark, d).select("doc_id", F.col("id").alias("clause_id"), "number", "text").distinct()
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    good = c.join(r, ["doc_id", "doc_name", "version"]).join(t, ["doc_id", "clause_id"]).filter(F.col("number").eqNullSafe(F.col("clause_number")) & (F.trim("quote") != "") & F.contains(plain(F.col("text")), plain(F.col("quote"))))
    return good.groupBy("owner_kind", "owner_id").agg(F.count_distinct("doc_id", "clause_id", "quote").alias("n_sources"))


@query
def unit_pair_consistency(spark, d):
    c = units.unit_changes(unit_rows(spark, d))
    return c.withColumn("ok", decisions.consistent_pair(F.col("status"), F.col("before_id"), F.col("after_id"))).groupBy("status", "ok").agg(F.count("*").alias("n"))


@query
def finding_explanations(spark, d):
    """Each function with sources in words: its category and its quotes in order."""
    c = citation_rows(spark, d).filter("owner_kind = 'function' AND quote IS NOT NULL").select("citation_id", "owner_id", "quote").distinct()
    q = c.groupBy("owner_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", "quote"))), lambda s: s["quote"]).alias("quotes"))
    f = functions(spark, d).select("id", "category").distinct()
    return f.join(q.withColumnRenamed("owner_id", "id"), "id").select("id", decisions.explanation(F.col("category"), F.col("quotes")).alias("explanation"))


# -- units in text


def _named(spark, d):
    return unit_rows(spark, d).select(F.col("id").alias("unit_id"), "name").dropna().distinct()


def _executor_texts(spark, d):
    return functions(spark, d).select(F.col("executor").alias("text")).dropna().distinct().select(F.col("text").alias("text_id"), "text")


@query
def unit_mentions(spark, d):
    """Units whose names, by stems, or abbreviations stand in executors as written."""
    return mentions.mentions(_executor_texts(spark, d), _named(spark, d)).groupBy("text_id").agg(F.count("*").alias("n_units"), F.min(F.struct("at", "unit_id"))["unit_id"].alias("first_unit"))


@query
def abbreviation_hits(spark, d):
    return mentions.abbreviation_hits(_executor_texts(spark, d), _named(spark, d)).groupBy("text_id").agg(F.count("*").alias("n_units"))


@query
def abbreviation_sets(spark, d):
    f = unit_rows(spark, d).select("id", mentions.abbreviations(F.col("name")).alias("a")).distinct().filter("size(a) > 0")
    return f.select("id", F.array_join(F.array_sort("a"), " ").alias("abbreviations"))


@query
def unit_enrichment(spark, d):
    """Executors in which dictionary candidates stand that are a unit by key or abbreviation."""
    found = mentions.found_units(_executor_texts(spark, d))
    return mentions.enriched_units(_named(spark, d), found).groupBy("unit_id").agg(F.count("*").alias("n_texts"))


@query
def merged_units(spark, d):
    """Units of a version that are one by name, under the smallest id."""
    return units.merged_units(unit_rows(spark, d))


@query
def unique_roots(spark, d):
    return mentions.unique_roots(unit_rows(spark, d))


@query
def executor_owners(spark, d):
    """The unit that each executor, as written, belongs to by the names in it."""
    texts = _executor_texts(spark, d)
    shelf = Shelf(spark, "owners")
    said = shelf.put(mentions.mentions(texts, _named(spark, d)))
    tree = shelf.put(hierarchy.hierarchy(table(spark, d, "units").select("id", "parent")).select("unit_id", "path", "depth"))
    return mentions.owners(texts.select("text_id", F.lit(True).alias("has_executor")), said.limit(0), said, tree)


@query
def lead_in_positions(spark, d):
    return mentions.positions(clause_rows(spark, d))


@query
def structure_scope(spark, d):
    return mentions.structure_clauses(clause_rows(spark, d).select("doc_id", "id", "section_path").distinct()).groupBy("doc_id").agg(F.count("*").alias("n_clauses"))


@query
def unit_clauses(spark, d):
    """Clauses in the functions' sections that a unit's citations name."""
    scope = performers.clauses_in_scope(clause_rows(spark, d), "функци|задач|обязанност|полномочи")
    sources = citation_rows(spark, d).filter("owner_kind = 'unit'").select(F.col("owner_id").alias("unit_id"), "clause_id").distinct()
    return mentions.selected_clauses(scope, sources, _named(spark, d)).groupBy("unit_id").agg(F.count("*").alias("n_clauses"))


@query
def sees_prohibition(spark, d):
    """Clauses that are prohibitions by their own text or their lead-in's."""
    c = clause_rows(spark, d).select("id", "text", "lead_in").distinct()
    hit = (F.coalesce(T.modality("text"), F.lit("")) == "prohibition") | (F.coalesce(T.lead_in_modality("lead_in"), F.lit("")) == "prohibition")
    return c.select("id", hit.alias("seen")).groupBy("id").agg(F.max("seen").alias("seen"))


# -- clauses of functions


def _first_source(spark, d):
    c = citation_rows(spark, d).filter("owner_kind = 'function'").select("citation_id", "owner_id", "doc_id", "clause_id").distinct()
    return c.groupBy(F.col("owner_id").alias("id")).agg(F.min_by("doc_id", "citation_id").alias("doc_id"), F.min_by("clause_id", "citation_id").alias("clause_id"))


@query
def clause_context(spark, d):
    """The texts behind a function's context numbers, in the document of its first source."""
    f = table(spark, d, "org_functions").select("id", "context_clause_numbers").distinct().join(_first_source(spark, d).select("id", "doc_id"), "id")
    return mentions.context_of(f, clause_rows(spark, d)).select("id", F.size("context").alias("n"), F.array_join("context", " | ").alias("context"))


@query
def reference_labels(spark, d):
    return mentions.reference_labels(clause_rows(spark, d))


@query
def function_lead_ins(spark, d):
    return mentions.lead_in_of(citation_rows(spark, d))


@query
def allowed_numbers(spark, d):
    f = table(spark, d, "org_functions").select("id", "context_clause_numbers").distinct()
    return mentions.allowed_numbers(f, citation_rows(spark, d)).select("id", F.array_join("numbers", " ").alias("numbers"))


@query
def cited_numbers(spark, d):
    texts = clause_rows(spark, d).select(F.col("id").alias("text_id"), "doc_id", "text").distinct()
    return mentions.cited_numbers(texts, clause_rows(spark, d))


@query
def clause_owner_groups(spark, d):
    """Clauses by owner, in order: how many a unit's functions rest on in a document, and the first of them."""
    f = functions(spark, d).select("id", "unit_id").distinct()
    c = clause_rows(spark, d).select("doc_id", F.col("id").alias("clause_id"), "clause_index").distinct()
    rows = citation_rows(spark, d).filter("owner_kind = 'function'").select(F.col("owner_id").alias("id"), "doc_id", "clause_id").distinct().join(f, "id").join(c, ["doc_id", "clause_id"])
    return rows.groupBy("doc_id", F.coalesce("unit_id", F.lit("")).alias("owner")).agg(F.count_distinct("clause_id").alias("n_clauses"), F.min("clause_index").alias("first_index"))


@query
def clauses_by_version(spark, d):
    r = table(spark, d, "regulations").select(F.col("id").alias("doc_id"), "version", "kind")
    return clause_rows(spark, d).select("doc_id", "id").distinct().join(r, "doc_id").groupBy("version", "kind").agg(F.count("*").alias("n_clauses"))


# -- owners and constraints


@query
def owner_contexts(spark, d):
    """Functions, abbreviations and prohibitions of each owner; those for all owners are counted once, in every row, from one number."""
    f = functions(spark, d).select("id", "unit_id", "text", "executor", "modality").distinct()
    own = performers.owner_groups(f.filter("modality <> 'prohibition'"))
    of = own.groupBy("owner").agg(F.count_distinct("id").alias("n_functions"))
    abbr = own.select("owner", F.explode(mentions.abbreviations(F.col("text"))).alias("a")).groupBy("owner").agg(F.count_distinct("a").alias("n_abbreviations"))
    scope = mentions.constraint_scope(f.filter("modality = 'prohibition'").select(F.col("id").alias("constraint_id"), "unit_id", "executor"), of)
    ban = scope.filter("owner IS NOT NULL").groupBy("owner").agg(F.count_distinct("constraint_id").alias("n_own"))
    everyone = scope.filter("owner IS NULL").agg(F.count_distinct("constraint_id").alias("n_all"))  # one row
    rows = of.join(abbr, "owner", "left").join(ban, "owner", "left").join(F.broadcast(everyone), how="cross")
    return rows.select("owner", "n_functions", F.coalesce("n_abbreviations", F.lit(0)).alias("n_abbreviations"), (F.coalesce("n_own", F.lit(0)) + F.col("n_all")).alias("n_constraints"))


@query
def constraint_scope(spark, d):
    f = functions(spark, d).select("id", "unit_id", "executor", "modality").distinct()
    owners = performers.owner_groups(f.filter("modality <> 'prohibition'")).select("owner").distinct()
    out = mentions.constraint_scope(f.filter("modality = 'prohibition'").select(F.col("id").alias("constraint_id"), "unit_id", "executor"), owners)
    return out.groupBy("owner").agg(F.count("*").alias("n"))


@query
def function_action(spark, d):
    """Leading acts by class, and the main word of what they act on."""
    a = functions(spark, d).select("id", "text", "executor").distinct().select("id", performers.action("text", "executor").alias("a"))
    return a.select("id", performers.head_word("a.object").alias("head"), *[performers.act_class(F.col("a.verbs"), c).alias(c) for c in ("strong", "weak", "initiate", "execute", "refer")])


# -- the report


@query
def full_stats(spark, d):
    """Every counter of the report: units by change, functions, matches by status, what awaits a check, prohibitions."""
    u, f, v = unit_rows(spark, d), functions(spark, d), link_rows(spark, d)
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stat"), F.col("n").cast("long").alias("value"))
    changes = Shelf(spark, "stats").put(units.unit_changes(u))
    components = Shelf(spark, "stats").put(_summary(spark, d)[0])
    parts = [one(changes.filter("before_id IS NOT NULL"), "units_before"), one(changes.filter("after_id IS NOT NULL"), "units_after")]
    parts += [one(f.filter(F.col("version") == x).select("id").distinct(), f"functions_{x}") for x in ("before", "after")]
    parts += [one(components, "matches"), one(f.filter("modality = 'prohibition'").select("id").distinct(), "constraints")]
    parts += [one(v.filter("verification = 'llm' AND confidence < 0.5"), "unverified_candidates")]
    kinds = changes.groupBy(F.concat(F.lit("units_"), F.col("status")).alias("stat")).agg(F.count("*").alias("value"))
    statuses = components.groupBy(F.col("status").alias("stat")).agg(F.count("*").alias("value"))
    out = kinds.unionByName(statuses)
    for p in parts:
        out = out.unionByName(p)
    keys = [*report.REQUIRED_STATS, "units_kept", "units_transformed", "units_created", "units_abolished", "kept", "changed", "moved", "constraints"]
    every = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "stat string")
    return every.join(out, "stat", "left").select("stat", F.coalesce("value", F.lit(0)).alias("value"))


@query
def component_stats(spark, d):
    """Components by kind, status and assignment."""
    return _summary(spark, d)[0].groupBy("kind", "status", "assignment").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query
def units_by_version(spark, d):
    """Units of each version, once, whatever changes name them."""
    c = units.unit_changes(unit_rows(spark, d))
    side = lambda col, v: c.filter(F.col(col).isNotNull()).select(F.lit(v).alias("version"), F.col(col).alias("unit_id"))
    return side("before_id", "before").unionByName(side("after_id", "after")).distinct().groupBy("version").agg(F.count("*").alias("n_units"), F.min("unit_id").alias("first_unit"))


@query
def finding_sources(spark, d):
    """Distinct sources behind linked functions and units, by kind of finding."""
    c = citation_rows(spark, d).select("owner_kind", "owner_id", "doc_id", "clause_id", "quote").distinct()
    p = link_pairs(spark, d)
    linked = p.select(F.col("before_id").alias("owner_id")).unionByName(p.select(F.col("after_id").alias("owner_id"))).distinct()
    f = c.filter("owner_kind = 'function'").join(linked, "owner_id", "left_semi").withColumn("finding", F.lit("match"))
    u = c.filter("owner_kind = 'unit'").withColumn("finding", F.lit("unit"))
    every = f.unionByName(u).select("finding", "doc_id", "clause_id", "quote").distinct()
    return every.groupBy("finding").agg(F.count("*").alias("n_sources"), F.count_distinct("doc_id").alias("n_docs"))


@query
def unit_labels(spark, d):
    """Functions with the name of their unit; an unknown or nameless unit keeps its id."""
    names = unit_rows(spark, d).filter("name IS NOT NULL").groupBy(F.col("id").alias("unit_id")).agg(F.min("name").alias("name"))
    f = functions(spark, d).select("id", "unit_id").distinct()
    return f.join(names, "unit_id", "left").select("id", F.coalesce("name", "unit_id").alias("unit"))


@query
def verified_split(spark, d):
    """Findings that are settled and those that await a check, with their least confidence."""
    v = link_rows(spark, d).withColumn("verified", (F.col("verification") == "exact") | (F.col("confidence") >= 0.5))
    return v.groupBy(F.coalesce("verified", F.lit(False)).alias("verified"), "decision").agg(F.count("*").alias("n"), F.min("confidence").alias("least"))


@query
def match_payloads(spark, d):
    """Keys of the payloads under which verdicts on functions are stored."""
    names = unit_labels(spark, d)
    f = table(spark, d, "org_functions").select("id", "executor", "modality", "text", F.array_join("context_clause_numbers", ",").alias("section_path")).distinct()
    rows = f.join(names, "id")
    return report.with_payload_key(rows, ["id", "unit", "executor", "modality", "text", "section_path"]).select("id", "payload_key").distinct()


@query
def loss_second_search(spark, d):
    """For asked functions of 'before' whose last verdict is 'none': the nearest five functions and five clauses of 'after'."""
    from clauseflow.operators import retrieval

    lost = _last_verdicts(spark, d).filter("decision = 'none'").select(F.col("before_id").alias("id"))
    f = functions(spark, d).filter("modality <> 'prohibition'").select("id", "version", "text").distinct()
    q = asked(f.filter("version = 'before'").join(lost, "id", "left_semi"))
    r = table(spark, d, "regulations").filter("version = 'after'").select(F.col("id").alias("doc_id"))
    c = clause_rows(spark, d).select("doc_id", "id", "text").distinct().join(r, "doc_id").select("id", "text").distinct()
    out = None
    for kind, corpus in (("function", f.filter("version = 'after'").select("id", "text")), ("clause", c)):
        part = retrieval.bm25_top(q, "id", T.tokens("text"), retrieval.bm25_index(corpus, "id", T.tokens("text")), 5).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("query").alias("before_id"), "kind", F.col("id").alias("near_id"), F.round("score", 6).alias("score"), "rank")
