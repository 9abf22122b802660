"""SQL of the queries in decision_queries, written from their definitions."""

from __future__ import annotations

from clauseflow.plans.oracle import _ASK, _C, _F, _FIRST, _GROUPS, _P, _Q, _U, _V, _bm25, _key, _lead_modality, _modality, _norm, _tokens, _unit_key

# one unit a key and version: a unit without a key stays alone; equal keys of both versions are kept
_ONE = f"uk AS (SELECT DISTINCT id, version, coalesce(nullif({_unit_key('name')}, ''), 'id ' || id) AS k, nullif({_unit_key('name')}, '') IS NOT NULL AS named FROM u), one AS (SELECT version, k, bool_or(named) AS named, min(id) AS unit_id FROM uk GROUP BY 1, 2), of AS (SELECT DISTINCT id, version, unit_id FROM uk JOIN one USING (version, k))"
_CHANGE = _ONE + ", ch AS (SELECT b.unit_id AS before_id, a.unit_id AS after_id, CASE WHEN a.unit_id IS NULL THEN 'abolished' WHEN b.unit_id IS NULL THEN 'created' ELSE 'kept' END AS status FROM (SELECT * FROM one WHERE version = 'before') b FULL JOIN (SELECT * FROM one WHERE version = 'after') a ON a.k = b.k AND a.named AND b.named)"
_REL = (
    _CHANGE
    + f""", fo AS (SELECT DISTINCT f.id, coalesce(of.unit_id, f.unit_id) AS unit, f.executor FROM f LEFT JOIN of ON of.id = f.unit_id),
    rel AS (SELECT p.before_id, p.after_id, CASE WHEN x.unit = y.unit OR ch.status IS NOT NULL THEN 'same' WHEN x.unit IS NOT NULL AND y.unit IS NOT NULL THEN 'different'
        WHEN {_key('x.executor')} = {_key('y.executor')} AND ({_key('x.executor')} <> '' OR (x.unit IS NULL AND y.unit IS NULL)) THEN 'same' ELSE 'unknown' END AS relation
        FROM p JOIN fo x ON x.id = p.before_id JOIN fo y ON y.id = p.after_id LEFT JOIN ch ON ch.status = 'kept' AND ch.before_id = x.unit AND ch.after_id = y.unit)"""
)
_ASSIGN = f"""mem AS (SELECT DISTINCT group_id, member_id, version, executor FROM g JOIN f ON f.id = member_id),
    rg AS (SELECT group_id, list(DISTINCT relation) AS rs FROM rel JOIN g ON g.member_id = before_id GROUP BY 1),
    ex AS (SELECT group_id, list_sort(list(DISTINCT {_key('executor')}) FILTER (version = 'before')) AS eb, list_sort(list(DISTINCT {_key('executor')}) FILTER (version = 'after')) AS ea FROM mem WHERE coalesce(executor, '') <> '' GROUP BY 1),
    asg AS (SELECT group_id, CASE WHEN list_contains(rs, 'different') THEN 'moved' WHEN list_contains(rs, 'transformed') THEN 'transformed' WHEN len(eb) > 0 AND len(ea) > 0 AND eb <> ea THEN 'executor' WHEN rs = ['unknown'] THEN 'unknown' ELSE 'same' END AS assignment FROM rg LEFT JOIN ex USING (group_id))"""
_SUMMARY = (
    f"WITH RECURSIVE {_P}, {_F}, {_U}, {_GROUPS}, {_REL}, {_ASSIGN}"
    + """, n AS (SELECT group_id, count(DISTINCT member_id) FILTER (version = 'before') AS n_before, count(DISTINCT member_id) FILTER (version = 'after') AS n_after FROM mem GROUP BY 1),
    ld AS (SELECT group_id, decision, verification, confidence, before_id, coalesce(array_to_string(list_transform(after_ids, lambda x: coalesce(x, '?')), ','), '') AS ids FROM v JOIN g ON g.member_id = before_id WHERE decision <> 'none'),
    said AS (SELECT group_id, first(decision ORDER BY before_id, ids, decision, verification, coalesce(confidence, -1)) AS f, list(DISTINCT decision) AS ds, bool_and(verification = 'exact') AS x, min(confidence) AS confidence FROM ld GROUP BY 1),
    k AS (SELECT *, CASE WHEN n_before > 1 THEN 'merge' WHEN list_contains(ds, 'partial') THEN 'partial' WHEN n_after > 1 THEN 'split' WHEN list_contains(ds, 'merge') THEN 'merge' ELSE 'one_to_one' END AS kind, CASE f WHEN 'split' THEN 'changed' ELSE f END AS d FROM n JOIN said USING (group_id) LEFT JOIN asg USING (group_id)),
    su AS (SELECT group_id, n_before, n_after, kind, CASE WHEN kind <> 'one_to_one' THEN 'changed' WHEN d = 'moved' AND assignment IN ('same', 'transformed', 'executor') THEN 'changed' WHEN d IN ('kept', 'changed') AND assignment = 'moved' THEN 'moved' ELSE d END AS status, assignment, CASE WHEN x THEN 'exact' ELSE 'llm' END AS verification, confidence FROM k)"""
)
_MARK = r"[^\p{L}\p{N}_]"


def _upper_words(x: str) -> str:
    return rf"list_distinct(list_transform(list_filter(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[А-ЯЁ]{{2,8}}$')), lambda w: replace(lower(w), 'ё', 'е')))"


def _roots(x: str) -> str:
    return f"list_transform(regexp_extract_all(replace(lower({x}), 'ё', 'е'), '[a-zа-я0-9]+(?:-[a-zа-я0-9]+)*'), lambda w: left(w, 5))"


_ABBR = r"""ab AS (SELECT DISTINCT id AS unit_id, CASE WHEN len(i) > 0 THEN i[-1] WHEN regexp_matches(b, '^[А-ЯЁA-Z][А-ЯЁA-Z0-9\-]{1,11}$') THEN b END AS abbr FROM (SELECT id, regexp_extract_all(name, '\((?:[Дд]алее\s*[-–—]?\s*)?([А-ЯЁA-Z][А-ЯЁA-Z0-9\-]{1,11})\)', 1) AS i, regexp_replace(name, '^[ .,;:]+|[ .,;:]+$', '', 'g') AS b FROM u WHERE name IS NOT NULL))"""
_OWNERS = f"""f2 AS (SELECT DISTINCT id, unit_id, text, executor, modality FROM f), ow AS (SELECT *, coalesce(unit_id, CASE WHEN {_key('executor')} <> '' THEN 'executor:' || {_key('executor')} END) AS owner FROM f2 WHERE modality <> 'prohibition'),
    own AS (SELECT owner, count(DISTINCT id) AS n_functions FROM ow WHERE owner IS NOT NULL GROUP BY 1),
    sc AS (SELECT DISTINCT id, CASE WHEN unit_id IS NULL OR unit_id = '' OR unit_id NOT IN (SELECT owner FROM own) OR contains({_norm('executor')}, 'работник') THEN NULL ELSE unit_id END AS owner FROM f2 WHERE modality = 'prohibition')"""
_MENTION = f"""tx AS (SELECT DISTINCT executor AS t FROM org_functions WHERE executor IS NOT NULL), tw AS (SELECT t, {_roots('t')} AS w FROM tx),
    us AS (SELECT DISTINCT id AS unit_id, {_roots(_unit_key('name'))} AS s FROM u WHERE name IS NOT NULL), pos AS (SELECT t, w, unnest(range(1, len(w) + 1)) AS "at" FROM tw),
    run AS (SELECT t, unit_id, pos."at" FROM pos JOIN us ON len(s) > 0 AND w["at"] = s[1] AND w["at":"at" + len(s) - 1] = s),
    mn AS (SELECT t, unit_id, min("at") AS "at" FROM run GROUP BY 1, 2)"""

DECISIONS = {
    "component_summary": _SUMMARY + " SELECT * FROM su",
    "component_stats": _SUMMARY + " SELECT kind, status, assignment, count(*) AS n, round(avg(confidence), 6) AS confidence FROM su GROUP BY 1, 2, 3",
    "assignment_summary": f"WITH RECURSIVE {_P}, {_F}, {_U}, {_GROUPS}, {_REL}, {_ASSIGN} SELECT group_id, assignment FROM asg",
    "verified_links": f"""WITH {_P}, {_F}, lastv AS (SELECT before_id, first(after_ids ORDER BY loaded_at DESC, recorded_at DESC, decision DESC, after_ids DESC) AS ids, first(decision ORDER BY loaded_at DESC, recorded_at DESC, decision DESC, after_ids DESC) AS decision FROM links WHERE before_id IS NOT NULL GROUP BY 1),
        sh AS (SELECT DISTINCT before_id, after_id FROM p WHERE after_id IN (SELECT id FROM f WHERE version = 'after')), k AS (SELECT DISTINCT id, {_key('text')} AS k FROM f),
        e AS (SELECT before_id, ids[i] AS after_id, min(i) AS i FROM lastv, unnest(range(1, len(ids) + 1)) AS r(i) GROUP BY 1, 2),
        o AS (SELECT e.before_id, list(after_id ORDER BY i) AS ids, bool_and(kb.k IS NOT DISTINCT FROM ka.k) AS same FROM e JOIN sh USING (before_id, after_id) LEFT JOIN k kb ON kb.id = e.before_id LEFT JOIN k ka ON ka.id = e.after_id GROUP BY 1),
        j AS (SELECT x.before_id, l.decision, o.ids, o.same, CASE WHEN l.decision IS NULL THEN 'failure' WHEN l.decision = 'none' THEN 'none' WHEN o.ids IS NULL THEN 'failure' ELSE 'link' END AS outcome FROM (SELECT DISTINCT before_id FROM sh) x LEFT JOIN lastv l USING (before_id) LEFT JOIN o USING (before_id))
        SELECT before_id, outcome, decision, CASE WHEN outcome = 'link' THEN array_to_string(ids, ',') END AS after_ids, CASE WHEN outcome <> 'link' THEN NULL WHEN decision = 'kept' AND len(ids) = 1 AND same THEN 'exact' ELSE 'llm' END AS verification,
        CASE WHEN outcome <> 'link' THEN NULL WHEN decision = 'kept' AND len(ids) = 1 AND same THEN 1.0 WHEN decision IN ('kept', 'moved') THEN 0.9 WHEN decision = 'partial' THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence FROM j""",
    "every_function_once": _SUMMARY
    + """, fs AS (SELECT DISTINCT id, version FROM f WHERE modality <> 'prohibition'), st AS (SELECT member_id, min(status) AS status FROM mem JOIN su USING (group_id) GROUP BY 1), no AS (SELECT DISTINCT before_id FROM v WHERE decision = 'none' AND before_id IS NOT NULL)
        SELECT version, coalesce(status, CASE version WHEN 'after' THEN 'new' ELSE 'lost' END) AS status, status IS NOT NULL OR (version = 'after' AND id NOT IN (SELECT after_id FROM p)) OR (version <> 'after' AND id IN (SELECT before_id FROM no)) AS verified, count(*) AS n
        FROM fs LEFT JOIN st ON st.member_id = fs.id GROUP BY 1, 2, 3""",
    "conclusion_sources": rf"""WITH {_Q}, {_C}, x AS (SELECT DISTINCT owner_kind, owner_id, doc_id, doc_name, version, clause_id, clause_number, quote FROM q)
        SELECT owner_kind, owner_id, count(DISTINCT (x.doc_id, x.clause_id, x.quote)) AS n_sources FROM x JOIN regulations r ON r.id = x.doc_id AND r.name = x.doc_name AND r.version = x.version JOIN c ON c.doc_id = x.doc_id AND c.id = x.clause_id AND c.number IS NOT DISTINCT FROM x.clause_number
        WHERE trim(x.quote) <> '' AND contains(lower(trim(regexp_replace(c.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(x.quote, '\s+', ' ', 'g')))) GROUP BY 1, 2""",
    "unit_pair_consistency": f"WITH {_U}, {_CHANGE} SELECT status, CASE status WHEN 'created' THEN before_id IS NULL AND after_id IS NOT NULL WHEN 'abolished' THEN before_id IS NOT NULL AND after_id IS NULL ELSE before_id IS NOT NULL AND after_id IS NOT NULL END AS ok, count(*) AS n FROM ch GROUP BY 1, 2",
    "finding_explanations": f"WITH {_Q}, x AS (SELECT DISTINCT citation_id, owner_id, quote FROM q WHERE owner_kind = 'function' AND quote IS NOT NULL) SELECT f.id, category || ': ' || string_agg('«' || quote || '»', '; ' ORDER BY citation_id, quote) AS explanation FROM (SELECT DISTINCT id, category FROM org_functions) f JOIN x ON x.owner_id = f.id GROUP BY f.id, category",
    "abbreviation_sets": f"SELECT id, array_to_string(list_sort(a), ' ') AS abbreviations FROM (SELECT DISTINCT id, {_upper_words('name')} AS a FROM units) WHERE len(a) > 0",
    "abbreviation_hits": f"WITH {_U}, {_ABBR}, e AS (SELECT DISTINCT executor AS t, unnest({_upper_words('executor')}) AS w FROM org_functions WHERE executor IS NOT NULL) SELECT t AS text_id, count(DISTINCT unit_id) AS n_units FROM e JOIN ab ON replace(lower(abbr), 'ё', 'е') = w GROUP BY 1",
    "merged_units": f"WITH {_U}, {_ONE} SELECT DISTINCT id, version, unit_id FROM of",
    "unique_roots": f"WITH {_U} SELECT version, CASE WHEN count(DISTINCT (id, coalesce(trim(parent), ''))) FILTER (coalesce(trim(parent), '') = '') = 1 THEN min(id) FILTER (coalesce(trim(parent), '') = '') END AS root_id FROM u GROUP BY version",
    "structure_scope": f"WITH h AS (SELECT DISTINCT doc_id, id, section_path, len(list_filter(section_path, lambda p: starts_with(p, '3.') OR contains(lower(p), 'структур'))) > 0 AS hit FROM clauses), w AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS sm FROM h) SELECT doc_id, count(*) AS n_clauses FROM w WHERE hit OR NOT sm GROUP BY 1",
    "sees_prohibition": f"SELECT id, bool_or(coalesce({_modality('text')}, '') = 'prohibition' OR coalesce({_lead_modality('lead_in')}, '') = 'prohibition') AS seen FROM clauses GROUP BY id",
    "clause_context": f"""WITH {_C}, {_FIRST}, {_Q}, src AS (SELECT owner_id AS id, arg_min(doc_id, citation_id) AS doc_id FROM q WHERE owner_kind = 'function' GROUP BY 1),
        fx AS (SELECT DISTINCT id, context_clause_numbers AS ns FROM org_functions), e AS (SELECT DISTINCT fx.id, doc_id, i, ns[i] AS number FROM fx JOIN src USING (id), unnest(range(1, len(ns) + 1)) AS r(i)),
        t AS (SELECT e.id, left(first.text, 600) AS t, row_number() OVER (PARTITION BY e.id ORDER BY i, left(first.text, 600)) AS r FROM e JOIN first ON first.doc_id = e.doc_id AND first.number = e.number)
        SELECT id, CAST(count(*) AS INT) AS n, string_agg(t, ' | ' ORDER BY r) AS context FROM t WHERE r <= 3 GROUP BY id""",
    "reference_labels": "WITH x AS (SELECT DISTINCT doc_id, id, number, clause_index FROM clauses) SELECT doc_id, id, CASE WHEN row_number() OVER (PARTITION BY doc_id, coalesce(number, id) ORDER BY clause_index, id) = 1 THEN coalesce(number, id) ELSE id END AS ref FROM x",
    "function_lead_ins": f"WITH {_Q}, x AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY citation_id) AS r FROM (SELECT DISTINCT citation_id, owner_id, quote FROM q WHERE owner_kind = 'function')) SELECT owner_id, trim(arg_min(quote, citation_id)) AS lead_in FROM x WHERE r > 1 AND rtrim(quote) LIKE '%:' GROUP BY 1",
    "allowed_numbers": r"WITH x AS (SELECT owner_id AS id, clause_number AS n FROM citations WHERE owner_kind = 'function' UNION ALL SELECT id, unnest(context_clause_numbers) FROM org_functions), y AS (SELECT DISTINCT id, lower(regexp_replace(trim(n), '\.+$', '')) AS n FROM x) SELECT id, string_agg(n, ' ' ORDER BY n) AS numbers FROM y WHERE n <> '' AND id IS NOT NULL GROUP BY id",
    "cited_numbers": rf"""WITH {_C}, {_FIRST}, t AS (SELECT DISTINCT id AS text_id, doc_id, text FROM c), w AS (SELECT DISTINCT text_id, doc_id, unnest(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_.]+'), lambda x: regexp_replace(x, '\.+$', ''))) AS number FROM t)
        SELECT DISTINCT text_id, w.number, first.id AS clause_id FROM w JOIN first ON first.doc_id = w.doc_id AND first.number = w.number WHERE regexp_matches(w.number, '^[1-9][0-9]?(\.[0-9]+)+$')""",
    "clause_owner_groups": f"WITH {_Q}, {_C}, fu AS (SELECT DISTINCT id, unit_id FROM org_functions), x AS (SELECT DISTINCT q.doc_id, coalesce(unit_id, '') AS owner, q.clause_id, c.clause_index FROM q JOIN fu ON fu.id = q.owner_id JOIN c ON c.doc_id = q.doc_id AND c.id = q.clause_id WHERE owner_kind = 'function') SELECT doc_id, owner, count(DISTINCT clause_id) AS n_clauses, min(clause_index) AS first_index FROM x GROUP BY 1, 2",
    "clauses_by_version": "SELECT r.version, r.kind, count(*) AS n_clauses FROM (SELECT DISTINCT doc_id, id FROM clauses) c JOIN regulations r ON r.id = c.doc_id GROUP BY 1, 2",
    "constraint_scope": f"WITH {_F}, {_OWNERS} SELECT owner, count(*) AS n FROM sc GROUP BY owner",
    "owner_contexts": f"""WITH {_F}, {_OWNERS}, ab AS (SELECT owner, count(DISTINCT a) AS n FROM (SELECT owner, unnest({_upper_words('text')}) AS a FROM ow WHERE owner IS NOT NULL) GROUP BY 1)
        SELECT own.owner, n_functions, coalesce(ab.n, 0) AS n_abbreviations, (SELECT count(DISTINCT id) FROM sc WHERE sc.owner IS NULL OR sc.owner = own.owner) AS n_constraints FROM own LEFT JOIN ab ON ab.owner = own.owner""",
    "unit_mentions": f"""WITH {_U}, {_MENTION}, {_ABBR}, tok AS (SELECT DISTINCT t, unnest(list_concat(regexp_extract_all(t, '[А-Яа-яЁёA-Za-z0-9]+'), regexp_extract_all(t, '[А-Яа-яЁёA-Za-z0-9]+(?:-[А-Яа-яЁёA-Za-z0-9]+)+'))) AS w FROM tx),
        sh AS (SELECT t, unit_id, len({_roots("split_part(t, abbr, 1)")}) + 1 AS "at" FROM tok JOIN ab ON abbr = w), al AS (SELECT t, unit_id, min("at") AS "at" FROM (SELECT * FROM mn UNION ALL SELECT * FROM sh) GROUP BY 1, 2)
        SELECT t AS text_id, count(*) AS n_units, arg_min(unit_id, ("at", unit_id)) AS first_unit FROM al GROUP BY t""",
    "full_stats": _SUMMARY
    + f""", {_CHANGE.replace('uk AS', 'uk2 AS').replace('FROM uk ', 'FROM uk2 ').replace('one AS', 'one2 AS').replace('FROM one ', 'FROM one2 ').replace('JOIN one ', 'JOIN one2 ').replace('of AS', 'of2 AS').replace('ch AS', 'ch2 AS')}, t AS (
        SELECT 'units_before' AS stat, count(before_id) AS value FROM ch2 UNION ALL SELECT 'units_after', count(after_id) FROM ch2 UNION ALL SELECT 'functions_before', count(DISTINCT id) FROM f WHERE version = 'before' UNION ALL SELECT 'functions_after', count(DISTINCT id) FROM f WHERE version = 'after'
        UNION ALL SELECT 'matches', count(*) FROM su UNION ALL SELECT 'constraints', count(DISTINCT id) FROM f WHERE modality = 'prohibition' UNION ALL SELECT 'unverified_candidates', count(*) FROM v WHERE verification = 'llm' AND confidence < 0.5
        UNION ALL SELECT 'units_' || status, count(*) FROM ch2 GROUP BY status UNION ALL SELECT status, count(*) FROM su GROUP BY status)
        SELECT stat, coalesce(value, 0) AS value FROM (SELECT unnest(['units_before', 'units_after', 'functions_before', 'functions_after', 'matches', 'lost', 'new', 'duplicates', 'conflicts', 'unverified_candidates', 'units_kept', 'units_transformed', 'units_created', 'units_abolished', 'kept', 'changed', 'moved', 'constraints']) AS stat) LEFT JOIN t USING (stat)""",
    "units_by_version": f"WITH {_U}, {_ONE} SELECT version, count(*) AS n_units, min(unit_id) AS first_unit FROM one GROUP BY version",
    "finding_sources": f"WITH {_P}, {_Q}, li AS (SELECT before_id AS id FROM p UNION SELECT after_id FROM p), x AS (SELECT DISTINCT CASE owner_kind WHEN 'function' THEN 'match' ELSE 'unit' END AS finding, doc_id, clause_id, quote FROM q WHERE owner_kind = 'unit' OR (owner_kind = 'function' AND owner_id IN (SELECT id FROM li))) SELECT finding, count(*) AS n_sources, count(DISTINCT doc_id) AS n_docs FROM x GROUP BY 1",
    "unit_labels": "WITH nm AS (SELECT id, min(name) AS name FROM units WHERE name IS NOT NULL GROUP BY id) SELECT DISTINCT f.id, coalesce(name, unit_id) AS unit FROM org_functions f LEFT JOIN nm ON nm.id = f.unit_id",
    "verified_split": f"WITH {_V} SELECT coalesce(verification = 'exact' OR confidence >= 0.5, false) AS verified, decision, count(*) AS n, min(confidence) AS least FROM v GROUP BY 1, 2",
    "loss_second_search": f"""WITH {_F}, {_C}, lastv AS (SELECT before_id, first(decision ORDER BY loaded_at DESC, recorded_at DESC, decision DESC, after_ids DESC) AS decision FROM links WHERE before_id IS NOT NULL GROUP BY 1),
        g0 AS (SELECT DISTINCT id, version, text FROM f WHERE modality <> 'prohibition'), qq AS (SELECT id, text FROM g0 WHERE version = 'before' AND {_ASK} AND id IN (SELECT before_id FROM lastv WHERE decision = 'none')),
        fa AS (SELECT id, text FROM g0 WHERE version = 'after'), ca AS (SELECT DISTINCT c.id, c.text FROM c JOIN regulations r ON r.id = c.doc_id AND r.version = 'after'),
        {_bm25('s1', 'fa', 'id', _tokens('text'), 'qq', 'id', _tokens('text'))}, {_bm25('s2', 'ca', 'id', _tokens('text'), 'qq', 'id', _tokens('text'))},
        al AS (SELECT query, 'function' AS kind, id, score FROM s1 UNION ALL SELECT query, 'clause', id, score FROM s2)
        SELECT query AS before_id, kind, id AS near_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) AS INT) AS rank FROM al WHERE score > 0 QUALIFY rank <= 5""",
    "payload_hash": "SELECT DISTINCT id, left(sha256('{\"executor\": ' || coalesce(CAST(to_json(executor) AS VARCHAR), 'null') || ', \"id\": ' || CAST(to_json(id) AS VARCHAR) || ', \"modality\": ' || coalesce(CAST(to_json(modality) AS VARCHAR), 'null') || ', \"text\": ' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}'), 16) AS payload_key FROM (SELECT DISTINCT id, unit_id, version, text, category, modality, executor, signature FROM org_functions)",
}
