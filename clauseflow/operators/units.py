"""Units of two versions: phrases in text, matching by name, what changed, common ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow.functions import lexicon as L
from clauseflow.functions import text as T
from clauseflow.operators import graph, matching
from clauseflow.session import Shelf

MOST_WORDS = 8


def _phrase() -> str:
    """One expression for a unit in running text: the kind of unit, up to MOST_WORDS further words, an abbreviation in brackets.

    A word goes on with the name unless it is one that ends names, a verb, a post or another kind of unit; 'и' does if a
    word in small letters that may go on follows.
    """
    kind = "|".join(base + "(?:" + "|".join(sorted(ends, key=len, reverse=True)) + ")" for base, (_, ends) in L.UNIT_KINDS.items())
    end = "(?:" + "|".join(L.UNIT_NAME_ENDS).replace("ё", "[её]") + ")(?![А-Яа-яЁёA-Za-z0-9-])"
    verb = "(?-i:[а-яё]+(?:ет|ют|ит|ят|ется|ются|ится|ятся))(?![А-Яа-яЁёA-Za-z0-9-])"
    post = "(?:" + "|".join(L.UNIT_NAME_POSTS) + ")"
    stop = f"(?:{end}|{verb}|{post}|(?:{kind})(?![А-Яа-яЁёA-Za-z0-9-]))"
    word = "[А-Яа-яЁёA-Za-z0-9][А-Яа-яЁёA-Za-z0-9-]*"
    joined = rf"(?:и(?=[^\S\n]+(?-i:[а-яёa-z0-9]){word[len('[А-Яа-яЁёA-Za-z0-9]'):]})(?![^\S\n]+{end}))"
    step = rf"[^\S\n]+(?:{joined}(?![А-Яа-яЁёA-Za-z0-9-])|(?!и(?![А-Яа-яЁёA-Za-z0-9-])|{stop}){word})"
    abbreviation = r"(?:\s+(?:[Оо]бщества|[Кк]омпании))?\s*\((?:[Дд]алее\s*[-–—]?\s*)?(?-i:[А-ЯЁA-Z][А-ЯЁA-Z0-9\-]{1,11})\)"
    return rf"(?iu)(?<![а-яёa-z])((?:{kind})(?![а-яё])(?:{step}){{0,{MOST_WORDS}}}(?:{abbreviation})?)"


def phrases(text) -> Column:
    """Units that a text names: array of (name, abbreviation). The kind of unit is in its first case; a bare kind without an
    abbreviation is no unit, nor are 'управление' and 'группа' in small letters."""
    c = F.col(text) if isinstance(text, str) else text

    def one(p: Column) -> Column:
        found = F.regexp_extract(p, r"\((?:[Дд]алее\s*[-–—]?\s*)?([А-ЯЁA-Zа-яёa-z][А-ЯЁA-Zа-яёa-z0-9\-]{1,11})\)$", 1)
        bare = T.lower_e(T.squeeze(F.regexp_replace(F.regexp_replace(p, r"\s*\([^()]*\)$", ""), r"(?iu)(?:\s+(?:общества|компании|и))+$", "")))
        first, kind = F.regexp_extract(bare, r"^(\S*)", 1), None
        for base, (full, ends) in L.UNIT_KINDS.items():
            hit = first.rlike(f"^{base}(?:{'|'.join(ends)})$")
            kind = F.when(hit, full) if kind is None else kind.when(hit, full)
        rest = F.regexp_replace(bare, r"^\S*", "")
        small = kind.isin("управление", "группа") & p.rlike("^[а-яё]")
        ok = kind.isNotNull() & ((rest != "") | (found != "")) & ~small
        return F.when(ok, F.struct(F.concat(kind, rest).alias("name"), F.when(found != "", F.upper(found)).alias("abbreviation")))

    return F.array_compact(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_phrase()), F.lit(1)), one))


def unit_phrases(text: str | None) -> list[tuple[str, str | None]]:
    """`phrases` of one text."""
    return [tuple(x) for x in T.value_of(phrases, text)]


def candidate_units(clauses: DataFrame) -> DataFrame:
    """(doc_id, key, n_clauses, abbreviation): units that a document's clauses name, in text or lead-in."""
    text = clauses.select("doc_id", "id", F.explode(F.array("text", "lead_in")).alias("text")).filter(F.lower("text").rlike("|".join(L.UNIT_KINDS)))
    found = text.select("doc_id", "id", F.explode(phrases("text")).alias("u")).select("doc_id", "id", T.unit_name_key("u.name").alias("key"), "u.abbreviation")
    return found.groupBy("doc_id", "key").agg(F.countDistinct("id").alias("n_clauses"), F.min("abbreviation").alias("abbreviation"))


def _named(units: DataFrame) -> DataFrame:
    """(id, version, key, abbreviation) of units with id, name, version; an empty key is null."""
    key = F.nullif(T.unit_name_key("name"), F.lit("")).alias("key")
    # written, so that later plans don't hold the long expression of the key
    return Shelf(units.sparkSession, "unit-names").put(units.select("id", "version", key, T.abbreviation("name").alias("abbreviation")).distinct())


def _names(df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, name): key and abbreviation as rows; a key never equals an abbreviation."""
    return df.select(id_col, F.explode(F.array(F.concat(F.lit("k|"), "key"), F.concat(F.lit("a|"), "abbreviation"))).alias("name")).dropna().distinct()


def merged_units(units: DataFrame) -> DataFrame:
    """(id, version, unit_id): within a version, units of equal key or abbreviation are one, whose id is the smallest.

    Equality carries on: a unit that shares its key with a second and its abbreviation with a third makes all three one.
    units: id, name, version; a unit without name stays alone.
    """
    n = _named(units)
    k, a = F.concat_ws("|", F.lit("k"), "version", "key"), F.concat_ws("|", F.lit("a"), "version", "abbreviation")
    n = n.withColumn("k", F.when(F.col("key").isNotNull(), k)).withColumn("a", F.when(F.col("abbreviation").isNotNull(), a))
    labels = graph.propagate_min(n.select(F.col("k").alias("u"), F.col("a").alias("v"))).withColumnRenamed("node", "at")
    own = n.withColumn("at", F.coalesce("k", "a", F.concat(F.lit("i|"), "id"))).join(labels, "at", "left").select("id", "version", F.coalesce("label", "at").alias("label"))
    return own.join(own.groupBy("version", "label").agg(F.min("id").alias("unit_id")), ["version", "label"]).select("id", "version", "unit_id").distinct()


def merged_parents(units: DataFrame, merged: DataFrame) -> DataFrame:
    """(unit_id, parent): the first parent, in order of id, that a merged unit's members name, as the id of the unit it was merged into.

    A parent that isn't a unit stays as it is; a parent merged into the unit itself is none.
    """
    p = units.select("id", F.when(F.trim("parent") != "", F.col("parent")).alias("parent")).distinct()
    to = merged.select(F.col("id").alias("parent"), F.col("unit_id").alias("to")).distinct()
    known = merged.select("id", "unit_id").join(p, "id").join(to, "parent", "left").withColumn("parent", F.coalesce("to", "parent"))
    known = known.withColumn("at", F.when(F.col("parent") != F.col("unit_id"), F.struct("id", "parent")))
    return known.groupBy("unit_id").agg(F.min("at")["parent"].alias("parent"))


def parents_by_name(units: DataFrame, parent_name: str) -> DataFrame:
    """(id, parent_id): the first other unit of the version, in order of id, whose key or abbreviation is that of the name in `parent_name`."""
    named = _named(units)
    of = lambda df, i: _names(df.withColumn("at", F.struct("id", "version")), "at").select(F.col("at.id").alias(i), F.col("at.version").alias("version"), "name")
    asked = _named(units.select("id", "version", F.col(parent_name).alias("name")))
    hits = of(asked, "id").join(of(named, "parent_id"), ["version", "name"]).filter("id <> parent_id")
    return units.select("id").distinct().join(hits.groupBy("id").agg(F.min("parent_id").alias("parent_id")), "id", "left")


def unit_changes(units: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(before_id, after_id, status): one row per merged unit; kept for units that share a key or abbreviation, the rest abolished or created.

    Each unit of 'before', in order of id, takes the first unit of 'after' that is left. units: id, name, version; a unit without name
    matches nothing. merged: the result of `merged_units`, if there is one.
    """
    m = Shelf(units.sparkSession, "unit-changes").put(merged_units(units) if merged is None else merged)
    names = _names(_named(units).join(m, ["id", "version"]).withColumn("at", F.struct("version", "unit_id")), "at").select("at.*", "name")
    side = lambda v, c: names.filter(F.col("version") == v).select(F.col("unit_id").alias(c), "name")
    # a cap of one pair is the greedy pass; the letters keep ids of both sides apart
    pairs = side("before", "b").join(side("after", "a"), "name").select(F.concat(F.lit("b"), "b").alias("a"), F.concat(F.lit("n"), "a").alias("b"), F.lit(1.0).alias("similarity"))
    taken = matching.degree_cap(pairs, 1).select(F.expr("substring(a, 2)").alias("before_id"), F.expr("substring(b, 2)").alias("after_id"))
    b = m.filter("version = 'before'").select(F.col("unit_id").alias("before_id")).distinct()
    a = m.filter("version = 'after'").select(F.col("unit_id").alias("after_id")).distinct()
    both = b.join(taken, "before_id", "left").join(a, "after_id", "full")
    status = F.when(F.col("after_id").isNull(), "abolished").when(F.col("before_id").isNull(), "created").otherwise("kept")
    return both.select("before_id", "after_id", status.alias("status"))


def common_ancestor(pairs: DataFrame, tree: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `ancestor_id`, the lowest unit above both a and b (or one of them); null without one.

    tree: a hierarchy with `path`, the ids from the root down. The longest common beginning of two paths ends in it.
    """
    p = tree.select(F.col("unit_id").alias(a), F.col("path").alias("_p"))
    q = tree.select(F.col("unit_id").alias(b), F.col("path").alias("_q"))
    same = F.filter(F.zip_with("_p", "_q", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    return pairs.join(p, a, "left").join(q, b, "left").withColumn("ancestor_id", F.when(F.size(same) > 0, F.element_at(same, -1))).drop("_p", "_q")
