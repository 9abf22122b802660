"""The core queries: each operator over the whole tables it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.operators import clauses as C
from clauseflow.operators import graph, hierarchy, matching, performers, provenance, report, retrieval, units
from clauseflow.session import Shelf
from clauseflow.sources import docx
from clauseflow.sources.tables import table
from clauseflow.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- views of the tables: re-delivered rows once


def functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "org_functions").select("id", "unit_id", "version", "text", "category", "modality", "executor", "signature").distinct()


def clause_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clauses").drop("loaded_at").distinct()


def unit_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("id", "name", "version", "parent").distinct()


def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citations").drop("loaded_at").distinct()


def link_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select("before_id", "after_ids", "decision", "verification", "confidence").distinct()


def link_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(before_id, after_id) of rows that name both."""
    return link_rows(spark, d).select("before_id", F.explode("after_ids").alias("after_id")).dropna().distinct()


def asked(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The stated query set of searches: rows whose id (its first 8 hex digits) is divisible by 50."""
    return df.filter(F.conv(F.substring(id_col, 1, 8), 16, 10).cast("long") % 50 == 0)


# -- hierarchies (problem 1)


@query
def p1_found(spark, d):
    return hierarchy.roots_and_depths(table(spark, d, "units").select("id", "parent"))


@query
def p1_hierarchy(spark, d):
    tree = hierarchy.hierarchy(table(spark, d, "units").select("id", "parent"))
    return tree.selectExpr("unit_id", "parent_id", "root_id", "depth", "array_join(path, '/') AS path", "subtree_size", "on_circle")


@query
def p1_descendants(spark, d):
    return hierarchy.descendants(hierarchy.hierarchy(table(spark, d, "units").select("id", "parent")), circles=True)


# -- scalar functions and classifiers


@query
def text_fold(spark, d):
    return clause_rows(spark, d).select("id", T.fold("text").alias("folded")).distinct()


@query
def normalize_text(spark, d):
    f = functions(spark, d)
    return f.select("id", T.normalize_text("text").alias("key"), T.norm_lead("text").alias("lead_key"), T.quote_key("text").alias("quote_key")).distinct()


@query
def function_tokens(spark, d):
    return functions(spark, d).select("id", F.array_join(T.tokens("text"), " ").alias("tokens"), F.array_join(T.stems5("text"), " ").alias("stems")).distinct()


@query
def token_stats(spark, d):
    counts = retrieval.term_counts(functions(spark, d), "id", T.tokens("text"))
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query
def clause_modality(spark, d):
    c = clause_rows(spark, d)
    return c.select("id", T.modality("text").alias("own"), T.lead_in_modality("lead_in").alias("inherited"), T.clause_modality("text", "lead_in").alias("modality")).distinct()


@query
def template_filter(spark, d):
    return functions(spark, d).select("id", T.is_template_for_retrieval("text").alias("for_retrieval"), T.is_template_for_duplicates("text").alias("for_duplicates")).distinct()


@query
def verb_signature(spark, d):
    s = functions(spark, d).select("id", T.verb_class("text").alias("verb_class"), T.object_head("text").alias("object_head"), T.usable_signature(T.signature("text")).alias("signature"))
    return s.distinct()


@query
def doc_kind(spark, d):
    return table(spark, d, "regulations").select("id", T.document_kind("name").alias("kind"), T.safe_filename("name").alias("file_name"))


@query
def content_hash_ids(spark, d):
    c = clause_rows(spark, d)
    return c.select("id", T.text_sha256("text").alias("sha256"), F.substring(F.sha1("text"), 1, 12).alias("short_id"), T.document_prefix("id").alias("prefix")).distinct()


@query
def payload_hash(spark, d):
    return report.with_payload_key(functions(spark, d).select("id", "text", "executor", "modality"), ["id", "text", "executor", "modality"]).select("id", "payload_key")


@query
def number_algebra(spark, d):
    n = clause_rows(spark, d).select("number").filter("number IS NOT NULL").distinct()
    return n.select(
        "number", T.number_parent("number").alias("parent"), F.array_join(T.number_ancestors("number"), " ").alias("ancestors"),
        F.array_join(F.array_sort(T.number_successors("number")), " ").alias("successors"), T.number_key("number").alias("key"),
    )


@query
def unit_name_key(spark, d):
    return unit_rows(spark, d).filter("name IS NOT NULL").select("id", T.unit_name_key("name").alias("key"), T.abbreviation("name").alias("abbreviation")).distinct()


@query
def exclusion_reason(spark, d):
    """The first reason, in a fixed order, why a function is no side of a duplicate."""
    f = functions(spark, d)
    t = T.norm("text")
    reason = matching.first_reason([
        ("prohibition", F.col("modality") == "prohibition"), ("no unit", F.col("unit_id").isNull()), ("template", T.is_template_for_duplicates("text")),
        ("participation", t.rlike(r"(?:^|[^\p{L}])(?:участ|содейств|соисполн|помога)")), ("for approval", t.rlike(r"(?:^|[^\p{L}])на (?:согласовани|утверждени|подписани|рассмотрени)")),
    ])
    return f.select("id", reason.alias("reason")).distinct()


@query
def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"))


# -- retrieval


@query
def bm25_topk(spark, d):
    """Every evaluation item against all documents."""
    index = retrieval.bm25_index(table(spark, d, "documents", "doc_id", "text"), "doc_id", T.tokens("text"))
    out = retrieval.bm25_top(table(spark, d, "eval_items"), "item_id", T.tokens("text"), index)
    return out.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query
def exact_text_groups(spark, d):
    f = functions(spark, d).select("id", "version", T.normalize_text("text").alias("key")).distinct()
    g = f.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("version") == "before", 1)).alias("n_before"), F.min("id").alias("first_id"))
    return g.filter("n > 1").select("first_id", "n", "n_before")


@query
def signature_groups(spark, d):
    f = functions(spark, d).select("id", "unit_id", T.usable_signature("signature").alias("signature")).distinct().filter("signature IS NOT NULL")
    return f.groupBy("signature").agg(F.count("*").alias("n_functions"), F.count_distinct("unit_id").alias("n_units"))


@query
def signature_partners(spark, d):
    """Functions of other units with the same signature, counted without pairing them up."""
    f = functions(spark, d).select("id", "unit_id", T.usable_signature("signature").alias("signature")).distinct().dropna()
    own = f.groupBy("signature", "unit_id").agg(F.count("*").alias("own"))
    every = own.groupBy("signature").agg(F.sum("own").alias("every"))
    return f.join(own, ["signature", "unit_id"]).join(every, "signature").select("id", (F.col("every") - F.col("own")).alias("n_other_unit"))


@query
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = retrieval.cosine_top(e.filter("id % 50 = 0"), e)
    return out.select(F.col("query").alias("vec_id"), "id", F.round("cosine", 6).alias("cosine"), "rank")


def _sides(spark, d):
    f = functions(spark, d).filter("modality <> 'prohibition'").select("id", "version", "text", "signature", "unit_id")
    return f.filter("version = 'before'"), f.filter("version = 'after'")


@query
def rrf_topk(spark, d):
    before, after = _sides(spark, d)
    out = retrieval.rank_all(asked(before), after)
    return out.select(F.col("query").alias("before_id"), F.col("id").alias("after_id"), F.col("score").cast("string").alias("score"), "reasons", "rank")


@query
def reverse_augment(spark, d):
    """Forward candidates of the asked functions, augmented by every function of the other side that ranks one of them first."""
    before, after = _sides(spark, d)
    forward = retrieval.rank_all(asked(before), after)
    reverse = asked(retrieval.rank_all(after, before, k=1))
    out = retrieval.augment(forward, reverse)
    return out.select(F.col("query").alias("before_id"), F.col("id").alias("after_id"), "kind", "rank")


@query
def dup_pairs_cross_unit(spark, d):
    """Duplicate candidates of all functions of a version among functions of other units, without templates, as canonical pairs."""
    f = functions(spark, d).filter("modality <> 'prohibition' AND unit_id IS NOT NULL").filter(~T.is_template_for_retrieval("text"))
    f = Shelf(spark, "duplicates").put(f.select("id", T.strip_templates("text").alias("text"), "signature", "unit_id", "version"))
    out = None
    for v in ("before", "after"):
        own = f.filter(F.col("version") == v)
        part = retrieval.rank_all(own, own, other_unit=True)
        out = part if out is None else out.unionByName(part)
    pairs = out.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).distinct()
    t = f.select("id", T.tokens("text").alias("t"))
    both = pairs.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", F.round(T.jaccard(F.array_distinct("ta"), F.array_distinct("tb")), 3).alias("similarity"))


@query
def link_similarity(spark, d):
    """How alike linked functions are: Jaccard of tokens (1 for equal keys) and of rough stems."""
    f = functions(spark, d)
    words = F.filter(F.regexp_extract_all(T.norm("text"), F.lit("[а-яa-z0-9-]+"), F.lit(0)), lambda w: F.length(w) > 2)
    t = f.select("id", T.normalize_text("text").alias("k"), F.array_distinct(T.tokens("text")).alias("t"), F.array_distinct(F.transform(words, T.rule_stem)).alias("s"))
    side = lambda p, i: t.select(F.col("id").alias(i), *[F.col(c).alias(p + c) for c in ("k", "t", "s")])
    both = link_pairs(spark, d).join(side("b", "before_id"), "before_id").join(side("a", "after_id"), "after_id")
    tokens = F.when(F.col("bk") == F.col("ak"), 1.0).otherwise(T.jaccard(F.col("bt"), F.col("at")))
    return both.select("before_id", "after_id", F.round(tokens, 3).alias("tokens"), F.round(T.jaccard(F.col("bs"), F.col("as")), 3).alias("stems"))


@query
def object_overlap(spark, d):
    """Overlap of what linked functions act on: 1 for equal object heads, else the share of the smaller side's words."""
    t = functions(spark, d).select("id", T.object_head("text").alias("h")).withColumn("w", F.array_distinct(F.transform(F.filter(F.split("h", " "), lambda w: w != ""), T.rule_stem)))
    side = lambda p, i: t.select(F.col("id").alias(i), F.col("h").alias(p + "h"), F.col("w").alias(p + "w"))
    both = link_pairs(spark, d).join(side("b", "before_id"), "before_id").join(side("a", "after_id"), "after_id")
    common, small = F.size(F.array_intersect("bw", "aw")), F.least(F.size("bw"), F.size("aw"))
    score = F.when((F.col("bh") == F.col("ah")) & (F.col("bh") != ""), 1.0).when(common == 0, 0.0).when(small >= 2, common / small).otherwise(T.jaccard(F.col("bw"), F.col("aw")))
    return both.select("before_id", "after_id", F.round(score, 6).alias("overlap"))


# -- decisions


@query
def verdict_left_join(spark, d):
    """The last verdict on each function of 'before'; none means no answer."""
    f = functions(spark, d).filter("version = 'before'").select(F.col("id").alias("before_id")).distinct()
    v = table(spark, d, "links").filter("before_id IS NOT NULL").withColumn("ids", F.array_join("after_ids", ",", "?"))
    return matching.with_verdicts(f, v, ["before_id"], [F.desc("loaded_at"), F.desc("recorded_at"), F.asc("decision"), F.asc_nulls_first("ids")], "decision")


@query
def call_budget(spark, d):
    """Which links' verdicts fit into a budget of calls, in order of loading; exact ones are free, a 'none' costs a second call."""
    v = table(spark, d, "links").groupBy("before_id", F.array_join("after_ids", ",", "?").alias("ids"), "decision", "verification").agg(F.min("loaded_at").alias("at"))
    v = v.filter("before_id IS NOT NULL").withColumn("key", F.concat_ws("|", "before_id", F.coalesce("ids", F.lit("-")), "decision", "verification"))
    v = v.withColumn("calls", F.when(F.col("verification") == "exact", 0).when(F.col("decision") == "none", 2).otherwise(1).cast("long"))
    v = v.withColumn("micros", F.unix_micros(F.col("at").cast("timestamp")))
    return matching.call_budget(v, "micros", "key", "calls", 400).select("key", "calls", "before", "allowed")


def _components(spark, d):
    rows = link_rows(spark, d).select(F.array_distinct(F.filter(F.concat(F.array("before_id"), F.coalesce("after_ids", F.array().cast("array<string>"))), lambda x: x.isNotNull())).alias("ids"))
    edges = rows.select(F.explode("ids").alias("u"), F.array_min("ids").alias("v"))
    return graph.propagate_min(edges)


@query
def link_components(spark, d):
    return _components(spark, d).select(F.col("node").alias("member_id"), F.col("label").alias("group_id"))


@query
def match_status(spark, d):
    """Kind, status and confidence of each group of linked functions."""
    labels = _components(spark, d)
    members = labels.join(functions(spark, d).select(F.col("id").alias("node"), "version").distinct(), "node").select(F.col("label").alias("group_id"), F.col("node").alias("member_id"), "version")
    rows = link_rows(spark, d).filter("before_id IS NOT NULL AND decision <> 'none'")
    links = rows.join(labels.withColumnRenamed("node", "before_id"), "before_id").select(F.col("label").alias("group_id"), "decision", "verification", "confidence")
    return matching.group_summary(members, links)


@query
def uncovered_before(spark, d):
    f = functions(spark, d).filter("version = 'before' AND modality <> 'prohibition'").select(F.col("id").alias("before_id")).distinct()
    return f.join(link_rows(spark, d).select("before_id").dropna().distinct(), "before_id", "left_anti")


@query
def new_after(spark, d):
    f = functions(spark, d).filter("version = 'after' AND modality <> 'prohibition'").select(F.col("id").alias("after_id")).distinct()
    return f.join(link_pairs(spark, d).select("after_id").distinct(), "after_id", "left_anti")


@query
def exact_links(spark, d):
    f = functions(spark, d).filter("modality <> 'prohibition'").select("id", "text", "modality", "unit_id", "version").distinct()
    return matching.exact_links(f.filter("version = 'before'"), f.filter("version = 'after'"))


@query
def dup_degree_cap(spark, d):
    """Linked pairs by similarity, at most five to a function, as one pass in that order would take them."""
    p = link_similarity(spark, d).filter("before_id <> after_id").select(F.least("before_id", "after_id").alias("a"), F.greatest("before_id", "after_id").alias("b"), F.col("tokens").alias("similarity"))
    return matching.degree_cap(p.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))


@query
def owner_relation(spark, d):
    """Whether linked functions have the same owner, by unit, lineage of units and executor."""
    merged = Shelf(spark, "owners").put(units.merged_units(unit_rows(spark, d)))
    one = merged.select(F.col("id").alias("unit_id"), F.col("unit_id").alias("one")).distinct()
    f = functions(spark, d).select("id", "unit_id", "executor").distinct().join(one, "unit_id", "left").withColumn("unit_id", F.coalesce("one", "unit_id"))
    side = lambda p, i: f.select(F.col("id").alias(i), F.col("unit_id").alias(p + "u"), F.col("executor").alias(p + "e"))
    kept = units.unit_changes(unit_rows(spark, d), merged).filter("status = 'kept'").select(F.col("before_id").alias("bu"), F.col("after_id").alias("au"), "status")
    both = link_pairs(spark, d).join(side("b", "before_id"), "before_id").join(side("a", "after_id"), "after_id").join(kept, ["bu", "au"], "left")
    rel = matching.owner_relation(F.col("bu"), F.col("au"), F.col("status"), F.col("be"), F.col("ae"))
    return both.select("before_id", "after_id", rel.alias("relation"))


@query
def constraint_pairs(spark, d):
    """Functions that may break a prohibition: same unit, same object head; prohibitions without unit hold for all."""
    f = functions(spark, d).select("id", "unit_id", "modality", T.object_head("text").alias("object")).distinct().filter("object <> ''")
    rule = f.filter("modality = 'prohibition'").select(F.col("id").alias("constraint_id"), F.col("unit_id").alias("rule_unit"), "object")
    pairs = f.filter("modality <> 'prohibition'").join(rule, "object").filter("rule_unit IS NULL OR rule_unit = unit_id")
    return pairs.select(F.col("id").alias("function_id"), "constraint_id")


@query
def rule_specificity(spark, d):
    """Of several decisions on one function the most specific one."""
    v = link_rows(spark, d).filter("before_id IS NOT NULL").select("before_id", "decision").distinct()
    return matching.most_specific(v, "before_id", "decision", ["merge", "split", "partial", "moved", "changed", "kept", "none"])


@query
def unit_changes(spark, d):
    return units.unit_changes(unit_rows(spark, d))


@query
def unit_lca(spark, d):
    """The lowest common unit above the owners of linked functions."""
    tree = hierarchy.hierarchy(table(spark, d, "units").select("id", "parent")).filter("path IS NOT NULL")
    f = functions(spark, d).select("id", "unit_id").distinct()
    pairs = link_pairs(spark, d).join(f.select(F.col("id").alias("before_id"), F.col("unit_id").alias("unit_b")), "before_id").join(f.select(F.col("id").alias("after_id"), F.col("unit_id").alias("unit_a")), "after_id")
    both = pairs.select("unit_b", "unit_a").dropna().distinct()
    return units.common_ancestor(both, tree, "unit_b", "unit_a")


@query
def candidate_units(spark, d):
    """Units that names and executors, as written, hold."""
    named = unit_rows(spark, d).select(F.lit("unit").alias("doc_id"), "id", F.col("name").alias("text"))
    executors = functions(spark, d).select(F.lit("function").alias("doc_id"), "id", F.col("executor").alias("text"))
    return units.candidate_units(named.unionByName(executors).withColumn("lead_in", F.lit(None).cast("string")))


# -- performers and actions


@query
def inherited_executors(spark, d):
    return performers.inherited_executors(clause_rows(spark, d))


@query
def function_scope(spark, d):
    return performers.clauses_in_scope(clause_rows(spark, d), "функци|задач|обязанност|полномочи").groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.count_distinct("section").alias("n_sections"))


@query
def owner_groups(spark, d):
    return performers.owner_groups(functions(spark, d)).groupBy("owner").agg(F.count_distinct("id").alias("n_functions"))


@query
def action_parse(spark, d):
    a = functions(spark, d).withColumn("a", performers.action("text", "executor"))
    return a.select("id", *[F.array_join(f"a.{c}", " ").alias(c) for c in ("aux", "verbs", "object")])


# -- clauses


@query
def clause_lookup(spark, d):
    req = citation_rows(spark, d).select(F.col("citation_id").alias("request_id"), "doc_id", F.coalesce("clause_number", "clause_id").alias("wanted")).distinct()
    return C.lookup(req, clause_rows(spark, d))


@query
def number_prefix_closure(spark, d):
    c = clause_rows(spark, d)
    return C.prefix_closure(c.filter("modality = 'prohibition'").select("doc_id", "id", "number"), c)


@query
def clause_paths(spark, d):
    return C.ancestor_labels(clause_rows(spark, d)).select("id", F.array_join("path", " / ").alias("path"))


@query
def lead_in_chain(spark, d):
    return C.lead_in_chain(clause_rows(spark, d))


@query
def docx_round_trip(spark, d):
    """Each regulation written as a .docx from its clauses and scanned again; one regulation is one file."""
    c = clause_rows(spark, d).select("doc_id", "clause_index", "id", F.concat_ws(". ", "number", "text").alias("p")).distinct()
    paras = c.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("clause_index", "id", "p"))), lambda x: x["p"]).alias("paragraphs"))

    def build(batches):
        for pdf in batches:
            yield pdf.assign(content=[docx.write_docx(list(p)) for p in pdf["paragraphs"]], path=[f"{i}.docx" for i in pdf["doc_id"]])[["path", "content"]]

    scanned = docx.clauses_of_files(paras.mapInPandas(build, "path string, content binary"), "before", max_bytes=None)
    return scanned.groupBy("path").agg(F.count("id").alias("n_clauses"), F.count("number").alias("n_numbered"), F.count("error").alias("n_errors"))


# -- provenance and report


@query
def provenance_check(spark, d):
    return provenance.check_citations(citation_rows(spark, d), clause_rows(spark, d))


@query
def provenance_gate(spark, d):
    c = citation_rows(spark, d)
    return provenance.owners_with_sources(provenance.check_citations(c, clause_rows(spark, d)), c)


@query
def provenance_dangling(spark, d):
    return citation_rows(spark, d).join(clause_rows(spark, d).select(F.col("id").alias("clause_id")).distinct(), "clause_id", "left_anti").select("citation_id", "clause_id").distinct()


@query
def quote_verbatim(spark, d):
    """Quotes found in clause or lead-in when read without case and edge punctuation."""
    c = citation_rows(spark, d).select("citation_id", "clause_id", "quote").distinct()
    t = clause_rows(spark, d).select(F.col("id").alias("clause_id"), F.array_compact(F.array("text", "lead_in")).alias("texts")).distinct()
    return c.join(t, "clause_id").select("citation_id", provenance.quote_in_any("quote", F.col("texts")).alias("verbatim")).groupBy("citation_id").agg(F.max("verbatim").alias("verbatim"))


@query
def merge_sources(spark, d):
    return provenance.merge_sources(citation_rows(spark, d), ["owner_kind", "owner_id"], ["doc_id", "clause_id"])


@query
def top_sources(spark, d):
    """The first three distinct sources of each owner, and how many more there are."""
    m = provenance.merge_sources(citation_rows(spark, d), ["owner_kind", "owner_id"], ["doc_id", "clause_id"])
    w = Window.partitionBy("owner_kind", "owner_id")
    return m.withColumn("more", F.greatest(F.count("*").over(w) - 3, F.lit(0))).filter("place <= 3").select("owner_kind", "owner_id", "place", "clause_id", "more")


@query
def all_sources(spark, d):
    return citation_rows(spark, d).select("doc_id", "clause_id", "quote").distinct().groupBy("doc_id").agg(F.count("*").alias("n_sources"), F.count_distinct("clause_id").alias("n_clauses"))


@query
def report_stats(spark, d):
    u, f, v = unit_rows(spark, d), functions(spark, d), link_rows(spark, d)
    n = lambda df: df.agg(F.count("*").alias("n"))
    ids = lambda df, version: n(df.filter(F.col("version") == version).select("id").distinct())
    return report.stats_rows({
        "units_before": ids(u, "before"), "units_after": ids(u, "after"), "functions_before": ids(f, "before"), "functions_after": ids(f, "after"),
        "matches": n(v.filter("decision <> 'none'")), "lost": n(uncovered_before(spark, d)), "new": n(new_after(spark, d)), "unverified_candidates": n(v.filter("verification = 'llm' AND confidence < 0.5")),
    })


@query
def facts_numbering(spark, d):
    """Changes of units and functions as numbered findings: units first, then lost, then new functions."""
    u = units.unit_changes(unit_rows(spark, d)).filter("status <> 'kept'").select(F.lit("units").alias("category"), F.coalesce("before_id", "after_id").alias("key"))
    lost = uncovered_before(spark, d).select(F.lit("lost").alias("category"), F.col("before_id").alias("key"))
    new = new_after(spark, d).select(F.lit("new").alias("category"), F.col("after_id").alias("key"))
    return report.numbered(u.unionByName(lost).unionByName(new), ["units", "lost", "new"], ["key"])


@query
def facet_counts(spark, d):
    v = link_rows(spark, d)
    return v.groupBy("decision", "verification").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query
def ref_scrub(spark, d):
    """Clause texts without references to clauses that the clause's own number and path don't name."""
    c = clause_rows(spark, d).select("id", "text", F.array_compact(F.array("number")).alias("allowed")).distinct()
    out = c.withColumn("s", report.scrubbed("text", "allowed"))
    return out.select("id", F.col("s.text").alias("text"), F.array_join("s.removed", ",").alias("removed"))


@query
def md_rows(spark, d):
    return report.markdown_rows(citation_rows(spark, d), "citation_id", ["doc_name", "version", "clause_number", "quote"])


@query
def source_labels(spark, d):
    return citation_rows(spark, d).filter("quote IS NOT NULL").select("citation_id", T.source_label("doc_name", "version", "clause_number", "quote").alias("label")).distinct()


@query
def late_arrivals(spark, d):
    """Functions per month of recording, and how many arrived more than five days later or before they were recorded."""
    f = table(spark, d, "org_functions").select("id", "recorded_at", "loaded_at").dropna()
    late = F.col("loaded_at") > F.col("recorded_at") + F.expr("INTERVAL 5 DAYS")
    g = f.groupBy(F.date_format("recorded_at", "yyyy-MM").alias("month"))
    return g.agg(F.count("*").alias("n"), F.count(F.when(late, 1)).alias("late"), F.count(F.when(F.col("loaded_at") < F.col("recorded_at"), 1)).alias("early"))


@query
def stream_arrivals(spark, d):
    """The same count as a stream: files as they come, repeats dropped within the watermark, windows of a day."""
    return arrivals.daily_counts(spark, f"{d}/org_functions.parquet", "recorded_at", "id")


from clauseflow.plans import decision_queries  # noqa: E402, F401  registers its queries
