"""Units in text: mentions by stems or abbreviation, owners of clauses and functions, positions, contexts, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.operators import clauses as C
from clauseflow.operators import performers, units
from clauseflow.session import Shelf

#: Stems of a name that a text must share in one run to be compared with it in full.
KEY_STEMS = 3


def abbreviations(text) -> Column:
    """Words of two to eight capitals, in small letters, each once."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike("^[А-ЯЁ]{2,8}$")), T.lower_e))


def mentions(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(text_id, unit_id, at): units that a text names, and the word where it first does.

    A name is mentioned where the stems of its words stand in the text one after another, or its abbreviation as a word of its own.
    texts: text_id, text; named: unit_id, name. Each text and name is cut once; they meet on the first KEY_STEMS stems, never all with all.
    """
    u = named.filter("name IS NOT NULL").select("unit_id", T.stems5(T.unit_name_key("name")).alias("s"), T.abbreviation("name").alias("abbr")).distinct()
    u = u.withColumn("k", F.least(F.size("s"), F.lit(KEY_STEMS)))
    t = texts.filter("text IS NOT NULL").select("text_id", "text", T.stems5("text").alias("w")).filter(F.size("w") > 0)
    lengths = F.array(*[F.lit(k) for k in range(1, KEY_STEMS + 1)])
    at = t.select("text_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")).select("*", F.explode(lengths).alias("k")).filter(F.col("at") + F.col("k") - 1 <= F.size("w"))
    at = at.withColumn("head", F.array_join(F.slice("w", F.col("at"), F.col("k")), " "))
    full = u.filter("k > 0").withColumn("head", F.array_join(F.slice("s", F.lit(1), F.col("k")), " "))
    run = at.join(full, ["k", "head"]).filter(F.slice("w", F.col("at"), F.size("s")) == F.col("s")).select("text_id", "unit_id", "at")
    words = lambda p: F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))
    token = t.select("text_id", "text", F.explode(F.array_union(words("[А-Яа-яЁёA-Za-z0-9]+"), words("[А-Яа-яЁёA-Za-z0-9]+(?:-[А-Яа-яЁёA-Za-z0-9]+)+"))).alias("abbr"))
    short = token.join(u.filter("abbr IS NOT NULL").select("unit_id", "abbr"), "abbr")
    before = F.size(T.stems5(F.expr("substring_index(text, abbr, 1)"))) + 1
    return run.unionByName(short.select("text_id", "unit_id", before.alias("at"))).groupBy("text_id", "unit_id").agg(F.min("at").alias("at"))


def abbreviation_hits(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(text_id, unit_id): texts that hold the abbreviation of a unit as a word. An equi-join on words."""
    u = named.select("unit_id", F.lower(T.abbreviation("name")).alias("abbr")).dropna().distinct()
    return texts.select("text_id", F.explode(abbreviations(F.col("text"))).alias("abbr")).join(u.withColumn("abbr", T.lower_e("abbr")), "abbr").select("text_id", "unit_id").distinct()


def unique_roots(named: DataFrame) -> DataFrame:
    """(version, root_id): the one unit of a version without parent; null where there are several or none."""
    top = named.select("id", "version", F.coalesce(F.trim("parent"), F.lit("")).alias("p")).distinct()
    return top.groupBy("version").agg(F.count(F.when(F.col("p") == "", 1)).alias("n"), F.min(F.when(F.col("p") == "", F.col("id"))).alias("r")).select("version", F.when(F.col("n") == 1, F.col("r")).alias("root_id"))


def owners(rows: DataFrame, in_text: DataFrame, in_executor: DataFrame, tree: DataFrame) -> DataFrame:
    """(text_id, owner_id, how): the unit that a row belongs to.

    The units that the executor names, narrowed to those that the text names too if that leaves one; else the only one of them; else the lowest unit above
    all of them. Without an executor, the same of the units in the text. rows: (text_id, has_executor); in_text, in_executor: results of `mentions`;
    tree: a hierarchy with `path`. How: narrowed, executor, text, common, none. An executor that names no unit gives none.
    """
    side = lambda m, c: m.groupBy("text_id").agg(F.array_sort(F.collect_set("unit_id")).alias(c))
    none = F.array().cast("array<string>")
    both = rows.join(side(in_text, "own"), "text_id", "left").join(side(in_executor, "found"), "text_id", "left")
    both = both.select("text_id", "has_executor", F.coalesce("own", none).alias("own"), F.coalesce("found", none).alias("found"))
    among = F.when(F.col("has_executor"), F.col("found")).otherwise(F.col("own"))
    narrow = F.array_intersect("own", "found")
    how = (
        F.when(F.size(among) == 0, "none").when(F.col("has_executor") & (F.size(narrow) == 1), "narrowed")
        .when(F.size(among) == 1, F.when(F.col("has_executor"), "executor").otherwise("text")).otherwise("common")
    )
    picked = both.withColumn("among", among).withColumn("narrow", narrow).withColumn("how", how)
    one = picked.withColumn("one", F.when(F.col("how") == "narrowed", F.get("narrow", F.lit(0))).when(F.col("how").isin("executor", "text"), F.get("among", F.lit(0))))
    up = tree.filter("path IS NOT NULL").select(F.col("unit_id").alias("u"), F.explode("path").alias("above"), F.col("depth"))
    deep = tree.select(F.col("unit_id").alias("above"), F.col("depth").alias("d"))
    several = one.filter("how = 'common'").select("text_id", F.size("among").alias("n"), F.explode("among").alias("u"))
    shared = several.join(up.select("u", "above"), "u").groupBy("text_id", "n", "above").agg(F.count("*").alias("c")).filter("c = n")
    lowest = shared.join(deep, "above").groupBy("text_id").agg(F.max_by("above", "d").alias("common"))
    return one.join(lowest, "text_id", "left").select("text_id", F.coalesce("one", "common").alias("owner_id"), F.when((F.col("how") == "common") & F.col("common").isNull(), "none").otherwise(F.col("how")).alias("how"))


def position(text) -> Column:
    """The position that heads a lead-in: what stands before its first separator or verb, if that is at most ten words and begins with a post."""
    t = F.regexp_replace(F.trim(text), r"(?iU)^\d+(?:\.\d+)*(?:\.[а-яё])?\.?(?:\s|$)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?iU)\(далее[^)]*\)", " "), r"(?s)[:,;].*$", "")
    t = F.regexp_replace(t, rf"(?iU)\s+(?:{'|'.join(performers.L.PERFORMER_ENDS)})(?![а-яё]).*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[ .,;–—-]+|[ .,;–—-]+$", "")
    posts = "|".join(p.replace(" ", r"\s+") for p in performers.L.UNIT_NAME_POSTS)
    ok = t.rlike(f"(?iu)^(?:{posts})") & (F.size(F.split(t, " ")) <= 10)
    return F.when(ok, F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def positions(clauses: DataFrame) -> DataFrame:
    """(doc_id, key, name, n_clauses): positions that lead-ins, and clauses that are lead-ins, name, with the clauses below them.

    clauses: doc_id, id, number, text, lead_in. Clauses nested below a hit by number count too.
    """
    head = F.array_compact(F.array("lead_in", F.when(F.rtrim("text").endswith(":"), F.col("text"))))
    hits = clauses.select("doc_id", "id", "number", F.explode(head).alias("h")).select("doc_id", "id", "number", position(F.col("h")).alias("name")).filter("name IS NOT NULL")
    # written, so that the plan doesn't hold the expression of the key over that of the name
    hits = Shelf(clauses.sparkSession, "positions").put(hits).withColumn("key", T.unit_name_key("name"))
    down = clauses.filter("number IS NOT NULL").select("doc_id", F.col("id").alias("below"), F.explode(T.number_ancestors("number")).alias("number"))
    nested = hits.filter("number IS NOT NULL").join(down, ["doc_id", "number"]).select("doc_id", "key", F.col("below").alias("id"))
    every = hits.select("doc_id", "key", "id").unionByName(nested).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_clauses"))
    return hits.groupBy("doc_id", "key").agg(F.min("name").alias("name")).join(every, ["doc_id", "key"])


def structure_clauses(clauses: DataFrame, number: str = "3", word: str = "структур") -> DataFrame:
    """Clauses of a document's part on structure: below a section of that number or with that word in the path; all of a document without one."""
    hit = F.exists("section_path", lambda p: p.startswith(f"{number}.") | F.contains(F.lower(p), F.lit(word)))
    rows = clauses.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    some = rows.groupBy("doc_id").agg(F.max("_hit").alias("_some"))
    return rows.join(some, "doc_id").filter("_hit OR NOT _some").drop("_hit", "_some")


def context_of(functions: DataFrame, clauses: DataFrame, most: int = 3, chars: int = 600) -> DataFrame:
    """(id, context): for each function the texts of the first `most` clauses that its context numbers name, each cut to `chars`.

    functions: id, doc_id, context_clause_numbers; clauses: doc_id, id, number, text, clause_index. Numbers without a clause don't count.
    """
    first = C.first_by_number(clauses).select("doc_id", "number", "text")
    asked = functions.select("id", "doc_id", F.posexplode("context_clause_numbers").alias("place", "number")).distinct()
    found = asked.join(first, ["doc_id", "number"]).select("id", "place", F.substring("text", 1, chars).alias("text"))
    w = Window.partitionBy("id").orderBy("place", "text")
    cut = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return cut.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda s: s["text"]).alias("context"))


def reference_labels(clauses: DataFrame) -> DataFrame:
    """(doc_id, id, ref): a clause's printed number; of clauses with one number the first in order has it, the rest their ids."""
    w = Window.partitionBy("doc_id", F.coalesce("number", "id")).orderBy("clause_index", "id")
    c = clauses.select("doc_id", "id", "number", "clause_index").distinct()
    return c.withColumn("_r", F.row_number().over(w)).select("doc_id", "id", F.when(F.col("_r") == 1, F.coalesce("number", "id")).otherwise(F.col("id")).alias("ref"))


def lead_in_of(citations: DataFrame) -> DataFrame:
    """(owner_id, lead_in): the first of a function's further sources whose quote ends in a colon."""
    c = citations.filter("owner_kind = 'function'").select("citation_id", "owner_id", "quote").distinct()
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy("citation_id"))
    rest = c.withColumn("_r", place).filter("_r > 1").filter(F.rtrim("quote").endswith(":"))
    return rest.groupBy("owner_id").agg(F.trim(F.min_by("quote", "citation_id")).alias("lead_in"))


def allowed_numbers(functions: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, numbers): clause numbers that may be named beside a function: its sources' and its context's, without final stops, sorted."""
    norm = lambda n: F.lower(F.regexp_replace(F.trim(n), r"\.+$", ""))
    own = citations.filter("owner_kind = 'function'").select(F.col("owner_id").alias("id"), norm(F.col("clause_number")).alias("n"))
    ctx = functions.select("id", F.explode("context_clause_numbers").alias("n")).select("id", norm(F.col("n")).alias("n"))
    return own.unionByName(ctx).filter("n <> ''").groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("numbers"))


def constraint_scope(constraints: DataFrame, owners: DataFrame) -> DataFrame:
    """(constraint_id, owner): which owners a prohibition binds: all if it has no unit, an unknown one, or speaks of workers; else its own.

    constraints: (constraint_id, unit_id, executor); owners: owner. Prohibitions for all are few rows with a flag (owner null), never multiplied by owners.
    """
    known = owners.select(F.col("owner").alias("unit_id")).distinct().withColumn("known", F.lit(True))
    rows = constraints.select("constraint_id", "unit_id", "executor").distinct().join(known, "unit_id", "left")
    everyone = F.col("unit_id").isNull() | (F.col("unit_id") == "") | F.col("known").isNull() | F.contains(T.norm("executor"), F.lit("работник"))
    return rows.select("constraint_id", F.when(~everyone, F.col("unit_id")).alias("owner")).distinct()


def selected_clauses(scope: DataFrame, sources: DataFrame, named: DataFrame) -> DataFrame:
    """(unit_id, clause_id): clauses in scope that a unit's sources name, or that mention the unit in text, lead-in or path.

    scope: id, text, lead_in, section_path; sources: (unit_id, clause_id); named: unit_id, name.
    """
    texts = scope.select(F.col("id").alias("text_id"), F.concat_ws(" | ", "text", "lead_in", F.array_join("section_path", " | ")).alias("text")).distinct()
    said = mentions(texts, named).select("unit_id", F.col("text_id").alias("clause_id"))
    return sources.join(scope.select(F.col("id").alias("clause_id")).distinct(), "clause_id", "left_semi").select("unit_id", "clause_id").unionByName(said).distinct()


def enriched_units(named: DataFrame, candidates: DataFrame) -> DataFrame:
    """(unit_id, text_id): texts in which dictionary candidates were found that are the unit by key or abbreviation.

    named: unit_id, name; candidates: (text_id, key, abbreviation), as units.phrases finds them.
    """
    u = named.filter("name IS NOT NULL").select("unit_id", T.unit_name_key("name").alias("key"), T.abbreviation("name").alias("abbreviation")).distinct()
    pair = lambda c: u.filter(f"{c} <> ''").select("unit_id", c).join(candidates.filter(f"{c} <> ''").select("text_id", c), c).select("unit_id", "text_id")
    return pair("key").unionByName(pair("abbreviation")).distinct()


def found_units(texts: DataFrame) -> DataFrame:
    """(text_id, key, abbreviation) of the units that texts name by their kind and further words."""
    found = texts.filter(F.lower("text").rlike("|".join(performers.L.UNIT_KINDS))).select("text_id", F.explode(units.phrases("text")).alias("u"))
    return found.select("text_id", T.unit_name_key("u.name").alias("key"), F.col("u.abbreviation").alias("abbreviation")).distinct()


def cited_numbers(texts: DataFrame, clauses: DataFrame) -> DataFrame:
    """(text_id, number, clause_id): numbers in prose that are printed numbers of clauses of the same document. texts: text_id, doc_id, text."""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_.]+)"), F.lit(1)), lambda w: F.regexp_replace(w, r"\.+$", ""))
    asked = texts.select("text_id", "doc_id", F.explode(F.array_distinct(F.filter(words, lambda w: w.rlike(r"^[1-9]\d?(?:\.\d+)+$")))).alias("number"))
    return asked.join(C.first_by_number(clauses).select("doc_id", "number", F.col("id").alias("clause_id")), ["doc_id", "number"]).select("text_id", "number", "clause_id").distinct()
