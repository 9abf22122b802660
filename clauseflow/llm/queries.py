"""Queries of the training-data operators, and the SQL they are checked against where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.llm import components, leakage, minhash, names, packing, pii, textform
from clauseflow.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_pairs(table(spark, sf_dir, "org_functions").select("id", "text"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function's group of near-duplicates."""
    return minhash.near_duplicate_groups(table(spark, sf_dir, "org_functions").select("id", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = components.link_groups(table(spark, sf_dir, "links").select("before_id", "after_ids"))
    return groups.select(F.col("member_id").alias("function_id"), "group_id")


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "units").select(F.lit("unit").alias("origin"), F.col("id").alias("record_id"), F.col("name").alias("spelling"))
    functions = table(spark, sf_dir, "org_functions").select(F.lit("function").alias("origin"), F.col("id").alias("record_id"), F.col("executor").alias("spelling"))
    return units.unionByName(functions)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(_spellings(spark, sf_dir), table(spark, sf_dir, "registry"))


def p4_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct spelling that was linked, its entity's official name, and the records that have it."""
    records = _spellings(spark, sf_dir).distinct()
    used = records.filter("spelling IS NOT NULL").groupBy("spelling").agg(F.count("*").alias("n_records"))
    return names.match_spellings(used, table(spark, sf_dir, "registry")).join(used, "spelling")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = table(spark, sf_dir, "citations").select("citation_id", "clause_id", "quote")
    return textform.lookalike_quotes(citations, table(spark, sf_dir, "clauses").select("id", "text"))


def p5_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause text in its one form."""
    clauses = table(spark, sf_dir, "clauses").select("id", "text").distinct()
    out = textform.canonicalize(clauses, "text")
    return out.select("id", "canonical", (F.col("canonical") != F.col("text")).alias("changed"))


def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "containers"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the packs are."""
    return packing.pack_fill(p6_packs(spark, sf_dir), table(spark, sf_dir, "containers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with the longest run of words in common, the share of the question's runs, and whether the answer stands there too."""
    leaks = leakage.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text", "answer"))
    return leaks.select("doc_id", "item_id", "run_words", F.round("score", 3).alias("score"), F.round("question_share", 4).alias("question_share"), "answer_found")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders."""
    return pii.masked(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p4_found": p4_found, "p4_spellings": p4_spellings, "p5_found": p5_found, "p5_clauses": p5_clauses, "p6_packs": p6_packs, "p6_fill": p6_fill, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found, "p8_masked": p8_masked}

ORACLE = {
    "p2_found": r"""
        WITH f AS (SELECT DISTINCT id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM org_functions WHERE id IS NOT NULL AND text IS NOT NULL),
        d AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM f WHERE t <> '')),
        g AS (SELECT DISTINCT k, substr(t, CAST(i AS BIGINT), 4) AS s FROM d, unnest(range(1, greatest(length(t) - 2, 2))) AS u(i)),
        n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
        c AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.k < y.k GROUP BY 1, 2),
        p AS (SELECT a, b FROM c JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE c >= 0.6 * (na.n + nb.n - c)),
        m AS (SELECT id, k FROM f JOIN d USING (t)),
        r AS (SELECT x.id AS i, y.id AS j FROM p JOIN m x ON x.k = a JOIN m y ON y.k = b
              UNION ALL SELECT x.id, y.id FROM m x JOIN m y ON x.k = y.k AND x.id < y.id)
        SELECT DISTINCT least(i, j) AS function_a, greatest(i, j) AS function_b FROM r WHERE i <> j""",
    "p3_found": r"""
        WITH RECURSIVE r AS (SELECT row_number() OVER () AS n, list_distinct(list_filter(list_prepend(before_id, coalesce(after_ids, [])), lambda x: x IS NOT NULL)) AS ids FROM links),
        e AS (SELECT DISTINCT list_min(ids) AS v, unnest(ids) AS u FROM r),
        s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        walk(id, low) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, walk.low FROM walk JOIN s ON s.u = walk.id WHERE walk.low < s.v)
        SELECT id AS function_id, min(low) AS group_id FROM walk GROUP BY id""",
    "p7_found": r"""
        WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        v AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS v FROM eval_items WHERE text IS NOT NULL),
        i AS (SELECT DISTINCT item_id, array_to_string(v[CAST(k AS BIGINT):CAST(k AS BIGINT) + 12], ' ') AS run FROM v, unnest(range(1, len(v) - 11)) AS u(k)),
        d AS (SELECT DISTINCT doc_id, array_to_string(w[CAST(k AS BIGINT):CAST(k AS BIGINT) + 12], ' ') AS run FROM w, unnest(range(1, len(w) - 11)) AS u(k))
        SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)""",
    "p7_report": r"""
        WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS v, regexp_extract_all(lower(coalesce(answer, '')), '[\p{L}\p{N}]+') AS a FROM eval_items WHERE text IS NOT NULL),
        i AS (SELECT * FROM e WHERE len(v) >= 13),
        ir AS (SELECT DISTINCT item_id, array_to_string(v[k:k + 12], ' ') AS run FROM i, unnest(range(1, len(v) - 11)) AS u(k)),
        dr AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS run FROM d, unnest(range(1, len(w) - 11)) AS u(k)),
        h AS (SELECT doc_id, item_id, k, run FROM dr JOIN ir USING (run)),
        g AS (SELECT doc_id, item_id, k - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k) AS island FROM h),
        longest AS (SELECT doc_id, item_id, max(n) + 12 AS run_words FROM (SELECT doc_id, item_id, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL),
        share AS (SELECT h.doc_id, h.item_id, count(DISTINCT h.run) / min(t.n) AS question_share FROM h JOIN (SELECT item_id, count(*) AS n FROM ir GROUP BY 1) t USING (item_id) GROUP BY ALL),
        tf AS (SELECT item_id, x, count(*) AS c FROM i, unnest(v) AS u(x) GROUP BY ALL),
        df AS (SELECT x, count(*) AS df FROM tf GROUP BY 1),
        al AS (SELECT count(*) AS n, avg(len(v)) AS mean FROM i),
        imp AS (SELECT tf.item_id, tf.x, ln(1 + (al.n - df + 0.5) / (df + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(i.v) / al.mean)) AS impact FROM tf JOIN df USING (x) JOIN i USING (item_id), al),
        p AS (SELECT DISTINCT doc_id, item_id, (k - 1) // 13 AS nth FROM h),
        pw AS (SELECT DISTINCT p.doc_id, p.item_id, p.nth, x FROM p JOIN d USING (doc_id), unnest(w[nth * 13 + 1:nth * 13 + 25]) AS u(x)),
        best AS (SELECT doc_id, item_id, max(s) AS score FROM (SELECT doc_id, item_id, nth, sum(impact) AS s FROM pw JOIN imp USING (item_id, x) GROUP BY ALL) GROUP BY ALL)
        SELECT doc_id, item_id, run_words, round(score, 3) AS score, round(question_share, 4) AS question_share,
            len(i.a) > 0 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.a, ' ') || ' ') AS answer_found
        FROM longest JOIN share USING (doc_id, item_id) JOIN best USING (doc_id, item_id) JOIN d USING (doc_id) JOIN i USING (item_id)""",
}

# look-alikes as people see them: full width as plain, Latin and Greek letters as the Russian ones of the same shape, hyphens as one
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _form(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}]', '', 'g'), '\p{{Zs}}', ' ', 'g')"
    return f"nfc_normalize(translate(translate({bare}, '{_WIDE}', '{_PLAIN}'), 'ABCEHIJKMOPSTXYaceijopsxyΑΒΕΗΙΚΜΟΡΤΥΧο‐‑⁃˗−﹣', 'АВСЕНІЈКМОРЅТХУасеіјорѕхуАВЕНІКМОРТУХо------'))"


ORACLE |= {
    "p2_groups": ORACLE["p2_found"].replace("WITH f AS", "WITH RECURSIVE f AS").split("r AS (SELECT x.id AS i")[0]
    + """s AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), walk(k, low) AS (SELECT k, k FROM d UNION SELECT s.v, walk.low FROM walk JOIN s ON s.u = walk.k WHERE walk.low < s.v),
        lab AS (SELECT k, min(low) AS low FROM walk GROUP BY k), gi AS (SELECT low, min(id) AS gid FROM m JOIN lab USING (k) GROUP BY low), nl AS (SELECT u AS k, count(*) AS n FROM s GROUP BY u)
        SELECT i.id AS function_id, coalesce(min(gid), i.id) AS group_id, coalesce(max(nl.n), 0) AS n_links FROM (SELECT DISTINCT id FROM org_functions WHERE id IS NOT NULL) i LEFT JOIN m ON m.id = i.id LEFT JOIN lab ON lab.k = m.k LEFT JOIN gi ON gi.low = lab.low LEFT JOIN nl ON nl.k = m.k GROUP BY i.id""",
    "p5_found": f"""WITH q AS (SELECT DISTINCT citation_id, clause_id, quote FROM citations WHERE quote IS NOT NULL), t AS (SELECT DISTINCT id, text FROM clauses WHERE text IS NOT NULL)
        SELECT DISTINCT citation_id FROM q JOIN t ON t.id = q.clause_id WHERE NOT contains(text, quote) AND contains({_form('text')}, {_form('quote')})""",
    "p5_clauses": f"SELECT id, {_form('text')} AS canonical, {_form('text')} <> text AS changed FROM (SELECT DISTINCT id, text FROM clauses)",
}
