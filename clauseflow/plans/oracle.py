"""SQL with the same meaning as the core queries, for DuckDB on the same tables."""

from __future__ import annotations

from clauseflow.functions import lexicon as L

_ENDS = "|".join(sorted(L.ENDINGS, key=len, reverse=True))
_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
_EDGE = r"[^\p{L}\p{N}_]"


def _low(x: str) -> str:
    return f"replace(lower({x}), 'ё', 'е')"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def _fold(x: str) -> str:
    return _squeeze(f"replace({_low(x)}, 'ß', 'ss')")


def _norm(x: str) -> str:
    return _squeeze(_low(f"coalesce({x}, '')"))


def _key(x: str) -> str:
    low = _low(f"coalesce({x}, '')")
    return rf"trim(regexp_replace(regexp_replace({low}, '^\s*(?:\d+(?:\.\d+)*\.?|[а-яa-z]\))\s+', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _lead(x: str) -> str:
    return _squeeze(rf"regexp_replace({_key(x)}, '\d+', ' ', 'g')")


def _quote(x: str) -> str:
    low = _low(f"coalesce({x}, '')")
    return rf"regexp_replace(regexp_replace(regexp_replace({low}, '[«»\"“”„'']', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), '^[ .;:,]+|[ .;:,]+$', '', 'g')"


def _stem(w: str) -> str:
    bare = f"regexp_replace({w}, '^(.{{4,}})(?:ся|сь)$', '\\1')"
    return f"CASE WHEN length({w}) <= 5 THEN {w} ELSE regexp_replace({bare}, '^(.{{4,}}?)(?:{_ENDS})$', '\\1') END"


def _tokens(x: str) -> str:
    low = _low("t")
    one = (
        rf"CASE WHEN regexp_matches(t, '^\d+(?:\.\d+)*\.?$') THEN regexp_replace(t, '\.$', '') WHEN regexp_matches(t, '^[A-ZА-ЯЁ][A-ZА-ЯЁ0-9]{{1,7}}$') THEN {low}"
        rf" WHEN {low} IN ({_STOP}) OR length({low}) < 2 THEN NULL ELSE {_stem(low)} END"
    )
    return rf"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '\d+(?:\.\d+)*\.?|[A-Za-zА-Яа-яЁё0-9]+'), lambda t: {one}), lambda t: t IS NOT NULL)"


def _marker(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _modality(x: str) -> str:
    t = _fold(f"coalesce({x}, '')")
    upto = f"regexp_extract({t}, '(?s)^(.*(?:^|{_EDGE}){_marker([*L.PROHIBITION, *L.RIGHT, *L.DUTY])})(?:$|{_EDGE})', 1)"
    ends = "".join(f" WHEN regexp_matches({upto}, '(?:^|{_EDGE}){_marker(words)}$') THEN '{name}'" for name, words in (("prohibition", L.PROHIBITION), ("right", L.RIGHT), ("duty", L.DUTY)))
    return f"CASE WHEN {upto} = '' THEN NULL{ends} END"


def _lead_modality(x: str) -> str:
    return f"CASE WHEN regexp_matches({_fold(f"coalesce({x}, '')")}, '(?:^|{_EDGE}){_marker(L.PROHIBITION)}(?:$|{_EDGE})') THEN 'prohibition' ELSE {_modality(x)} END"


def _strip(x: str) -> str:
    t = _key(x)
    for p in L.TEMPLATE_PATTERNS:
        # RE2 knows word boundaries of ASCII only
        t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_]){p}', '\1 ', 'g')"
    return _squeeze(t)


def _template_r(x: str) -> str:
    general = _tokens("'" + " ".join(L.GENERIC_WORDS) + "'")
    return f"len(list_filter({_tokens(_strip(x))}, lambda w: NOT list_contains({general}, w))) < 2"


def _template_d(x: str) -> str:
    left = _norm(x)
    general = rf"regexp_matches({left}, '(?:^|[^\p{{L}}\p{{N}}_])(?:(?:ин|друг|проч)[\p{{L}}\p{{N}}_]+\s+(?:функци|обязанност|полномочи|поручени|задани)|поручени[\p{{L}}\p{{N}}_]*\s+руководств)')"
    for p in L.TEMPLATE_PHRASES:
        left = f"replace({left}, '{p}', ' ')"
    return f"({general} OR len(list_filter(regexp_extract_all({left}, '[а-яa-z0-9-]+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP}))) < 3)"


def _head(x: str) -> str:
    t = f"trim(lower({x}))"
    for _ in range(2):
        t = f"regexp_replace({t}, '{L.AUXILIARY}', '')"
    return t


def _class(x: str) -> str:
    return "CASE" + "".join(f" WHEN regexp_matches({_head(x)}, '^(?:{stems})') THEN '{name}'" for name, stems in L.VERB_CLASSES) + f" ELSE '{L.OTHER_CLASS}' END"


def _object(x: str) -> str:
    t = rf"regexp_replace({_head(x)}, '^[а-яёa-z]+(?:\s+(?:и|или)\s+[а-яёa-z]+)?\s+', '')"
    stop = ", ".join(f"'{w}'" for w in L.OBJECT_STOP)
    words = f"list_filter(regexp_extract_all(regexp_extract({t}, '(?s)^([^;:(,]*)', 1), '[а-яёa-z0-9-]+'), lambda w: length(w) > 2 AND w NOT IN ({stop}) AND NOT regexp_matches(w, '^(?:{'|'.join(L.OBJECT_STOP_STEMS)})'))"
    return f"array_to_string({words}[1:6], ' ')"


def _usable(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '(?s)^[^|]+\|.*\S') THEN {x} END"


def _rule_stem(w: str) -> str:
    cut = f"regexp_replace({w}, '(?:ами|ями|ов|ев|ей|ий|ый|ой|ая|яя|ое|ее|ые|ие|ых|их|ым|им|ую|юю|ого|его|ому|ему|ах|ях|ам|ям|ом|ем|а|я|о|е|и|ы|у|ю|ь|й)$', '')"
    return f"left(CASE WHEN length({w}) > 3 AND {cut} <> '' THEN {cut} ELSE {w} END, 5)"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _number_key(x: str) -> str:
    return rf"translate(regexp_replace(lower(trim({x})), '\.+$', ''), '{L.NUMBER_LATIN}', '{L.NUMBER_CYRILLIC}')"


def _ancestors(x: str) -> str:
    return f"list_transform(range(1, len(string_split({x}, '.'))), lambda k: array_to_string(string_split({x}, '.')[1:k], '.'))"


def _unit_key(x: str) -> str:
    t = rf"regexp_replace({_low(x)}, '\([^)]*\)', ' ', 'g')"
    t = f"regexp_replace({_squeeze(f"regexp_replace({t}, '[«»\"“”„]', '', 'g')")}, '^[ .,;:–—-]+|[ .,;:–—-]+$', '', 'g')"
    first = rf"regexp_extract({t}, '^(\S*)', 1)"
    lemma = "CASE" + "".join(f" WHEN regexp_matches({first}, '^{base}(?:{'|'.join(ends)})$') THEN '{full}'" for base, (full, ends) in L.UNIT_KINDS.items()) + f" ELSE {first} END"
    return rf"regexp_replace({lemma} || regexp_replace({t}, '^\S*', ''), '(?: (?:общества|компании))+$', '')"


_F = "f AS (SELECT DISTINCT id, unit_id, version, text, category, modality, executor, signature FROM org_functions)"
_C = "c AS (SELECT DISTINCT doc_id, id, number, section, section_path, text, clause_index, lead_in, modality FROM clauses)"
_U = "u AS (SELECT DISTINCT id, name, version, parent FROM units)"
_Q = "q AS (SELECT DISTINCT citation_id, owner_kind, owner_id, doc_id, doc_name, version, clause_id, clause_number, quote FROM citations)"
_V = "v AS (SELECT DISTINCT before_id, after_ids, decision, verification, confidence FROM links)"
_P = _V + ", p AS (SELECT DISTINCT before_id, after_id FROM (SELECT before_id, unnest(after_ids) AS after_id FROM v) WHERE before_id IS NOT NULL AND after_id IS NOT NULL)"
_ASK = "(('0x' || left(id, 8))::BIGINT % 50 = 0)"

_UNITS = r"""WITH RECURSIVE n AS (SELECT id, min(CASE WHEN trim(parent) <> '' THEN parent END) AS p FROM units WHERE id IS NOT NULL GROUP BY id),
    e AS (SELECT n.id, q.id AS p FROM n LEFT JOIN n q ON n.p = q.id),
    up(id, a) AS (SELECT id, p FROM e WHERE p IS NOT NULL UNION SELECT up.id, e.p FROM up JOIN e ON e.id = up.a WHERE e.p IS NOT NULL),
    circle AS (SELECT id FROM up WHERE id = a),
    chain(id, a, d) AS (SELECT id, id, 0 FROM e UNION ALL SELECT chain.id, e.p, d + 1 FROM chain JOIN e ON e.id = chain.a WHERE e.p IS NOT NULL AND chain.id NOT IN (SELECT up.id FROM up JOIN circle c ON c.id = up.a)),
    tree AS (SELECT id, max(d) AS depth, max_by(a, d) AS root FROM chain GROUP BY id),
    never AS (SELECT up.id, min(a) AS root FROM up JOIN circle c ON c.id = up.a GROUP BY up.id)"""

_GROUPS = r"""r AS (SELECT list_distinct(list_filter(list_prepend(before_id, coalesce(after_ids, [])), lambda x: x IS NOT NULL)) AS ids FROM v),
    e AS (SELECT DISTINCT list_min(ids) AS a, unnest(ids) AS b FROM r),
    s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
    walk(id, low) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, walk.low FROM walk JOIN s ON s.a = walk.id WHERE walk.low < s.b),
    g AS (SELECT id AS member_id, min(low) AS group_id FROM walk GROUP BY id)"""


def _bm25(name: str, docs: str, doc_id: str, doc_tokens: str, queries: str, query_id: str, query_tokens: str) -> str:
    """CTEs of an index over `docs` and scores {name}(query, id, score)."""
    n = name
    return f"""{n}d AS (SELECT {doc_id} AS id, {doc_tokens} AS t FROM {docs}),
    {n}n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {n}d),
    {n}t AS (SELECT id, term, count(*) AS tf, max(k) AS len FROM (SELECT id, len(t) AS k, unnest(t) AS term FROM {n}d) GROUP BY id, term),
    {n}f AS (SELECT term, count(*) AS df FROM {n}t GROUP BY term),
    {n}w AS (SELECT t.term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS w FROM {n}t t JOIN {n}f f ON t.term = f.term, {n}n),
    {n}q AS (SELECT DISTINCT {query_id} AS query, unnest({query_tokens}) AS term FROM {queries}),
    {n} AS (SELECT query, id, round(sum(w), 9) AS score FROM {n}q JOIN {n}w USING (term) GROUP BY query, id)"""


def _rank(name: str, queries: str, corpus: str, cond: str = "TRUE") -> str:
    """CTEs of fused candidates {name}(query, id, score, reasons, rank); cond is on qu.unit_id, cu.unit_id, query and id."""
    n = name
    ok = lambda x: f"SELECT x.query, x.id{', x.score' if x == f'{n}b' else ''} FROM {x} x JOIN {queries} qu ON qu.id = x.query JOIN {corpus} cu ON cu.id = x.id WHERE {cond}"
    return f"""{_bm25(n + 'b', corpus, 'id', _tokens('text'), queries, 'id', _tokens('text'))},
    {n}x0 AS (SELECT a.id AS query, b.id FROM {queries} a JOIN {corpus} b ON {_key('a.text')} = {_key('b.text')} AND {_key('a.text')} <> ''),
    {n}x AS ({ok(f'{n}x0')}),
    {n}r AS (SELECT * FROM ({ok(f'{n}b')}) ANTI JOIN {n}x USING (query, id)),
    {n}l AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM {n}r WHERE score > 0 QUALIFY rank <= 20),
    {n}s0 AS (SELECT a.id AS query, b.id FROM {queries} a JOIN {corpus} b ON {_usable('a.signature')} = {_usable('b.signature')}),
    {n}s1 AS (SELECT * FROM ({ok(f'{n}s0')}) ANTI JOIN {n}x USING (query, id)),
    {n}s AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY coalesce(score, 0) DESC, id) AS rank FROM {n}s1 LEFT JOIN {n}r USING (query, id) QUALIFY rank <= 20),
    {n}p AS (SELECT query, id, 'lexical' AS pool, 1 / (60 + rank) AS part FROM {n}l UNION ALL SELECT query, id, 'signature', 1 / (60 + rank) FROM {n}s),
    {n}g AS (SELECT query, id, round(sum(part), 9) AS score, string_agg(pool, ',' ORDER BY pool) AS reasons FROM {n}p GROUP BY query, id UNION ALL SELECT query, id, 'inf'::DOUBLE, 'exact' FROM {n}x),
    {n} AS (SELECT query, id, score, reasons, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM {n}g QUALIFY rank <= 5)"""


_SIDES = _F + ", fb AS (SELECT DISTINCT id, text, signature, unit_id FROM f WHERE version = 'before' AND modality <> 'prohibition'), fa AS (SELECT DISTINCT id, text, signature, unit_id FROM f WHERE version = 'after' AND modality <> 'prohibition')"
_AUGMENT = f"""qb AS (SELECT * FROM fb WHERE {_ASK}), qa AS (SELECT * FROM fa WHERE {_ASK}), {_rank('w', 'qb', 'fa')}, {_rank('z', 'qa', 'fb')},
    ad AS (SELECT id AS query, query AS id FROM z WHERE rank = 1),
    m AS (SELECT coalesce(w.query, ad.query) AS query, coalesce(w.id, ad.id) AS id, CASE WHEN w.reasons = 'exact' THEN 0 WHEN ad.id IS NOT NULL THEN 1 ELSE 2 END AS kind, coalesce(w.rank, 1073741824) AS fr FROM w FULL JOIN ad ON w.query = ad.query AND w.id = ad.id)"""

_CHANGES = f"""uk AS (SELECT DISTINCT id, version, nullif({_unit_key('name')}, '') AS key FROM u),
    un AS (SELECT *, CASE WHEN key IS NOT NULL THEN row_number() OVER (PARTITION BY version, key ORDER BY id) END AS nth FROM uk),
    ch AS (SELECT b.id AS before_id, a.id AS after_id, CASE WHEN a.id IS NULL THEN 'abolished' WHEN b.id IS NULL THEN 'created' ELSE 'kept' END AS status
           FROM (SELECT * FROM un WHERE version = 'before') b FULL JOIN (SELECT * FROM un WHERE version = 'after') a ON a.key = b.key AND a.nth = b.nth)"""
_LOST = "lost AS (SELECT DISTINCT id AS before_id FROM f WHERE version = 'before' AND modality <> 'prohibition' AND id NOT IN (SELECT before_id FROM v WHERE before_id IS NOT NULL))"
_NEW = "new AS (SELECT DISTINCT id AS after_id FROM f WHERE version = 'after' AND modality <> 'prohibition' AND id NOT IN (SELECT after_id FROM p))"
_MERGED = "m AS (SELECT *, row_number() OVER (PARTITION BY owner_kind, owner_id ORDER BY citation_id) AS place FROM (SELECT min(citation_id) AS citation_id, owner_kind, owner_id, doc_id, clause_id FROM q GROUP BY ALL))"
_CELL = lambda c: rf"CASE WHEN trim(regexp_replace(replace(coalesce({c}, ''), '|', '\|'), '[\r\n]+', ' ', 'g')) = '' THEN '—' ELSE trim(regexp_replace(replace(coalesce({c}, ''), '|', '\|'), '[\r\n]+', ' ', 'g')) END"
_FIRST = "first AS (SELECT * FROM c WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY clause_index, id) = 1)"

ORACLE: dict[str, str] = {
    "p1_found": _UNITS + " SELECT tree.id AS unit_id, coalesce(never.root, tree.root) AS root_id, CAST(CASE WHEN never.id IS NULL THEN depth ELSE -1 END AS BIGINT) AS depth FROM tree LEFT JOIN never ON never.id = tree.id",
    "p1_descendants": _UNITS + " SELECT a AS ancestor_id, id AS unit_id, CAST(d AS BIGINT) AS distance FROM chain WHERE d > 0",
    "p1_hierarchy": _UNITS + """ , below AS (SELECT a AS id, count(DISTINCT chain.id) AS n FROM chain GROUP BY a)
        SELECT e.id AS unit_id, e.p AS parent_id, coalesce(never.root, tree.root) AS root_id, CAST(CASE WHEN never.id IS NULL THEN depth ELSE -1 END AS BIGINT) AS depth,
        CASE WHEN never.id IS NULL THEN (SELECT string_agg(a, '/' ORDER BY d DESC) FROM chain x WHERE x.id = e.id) END AS path,
        CASE WHEN never.id IS NULL THEN below.n ELSE (SELECT count(*) FROM (
            WITH RECURSIVE hang(id) AS (SELECT e.id UNION SELECT k.id FROM e k JOIN hang ON k.p = hang.id WHERE k.id NOT IN (SELECT id FROM circle)) SELECT id FROM hang)) END AS subtree_size,
        e.id IN (SELECT id FROM circle) AS on_circle FROM e JOIN tree ON tree.id = e.id LEFT JOIN never ON never.id = e.id LEFT JOIN below ON below.id = e.id""",
    "text_fold": f"SELECT DISTINCT id, {_fold('text')} AS folded FROM clauses",
    "normalize_text": f"SELECT DISTINCT id, {_key('text')} AS key, {_lead('text')} AS lead_key, {_quote('text')} AS quote_key FROM org_functions",
    "function_tokens": f"SELECT DISTINCT id, array_to_string({_tokens('text')}, ' ') AS tokens, array_to_string(list_transform(regexp_extract_all({_low('text')}, '[a-zа-я0-9]+(?:-[a-zа-я0-9]+)*'), lambda w: left(w, 5)), ' ') AS stems FROM org_functions",
    "token_stats": f"WITH {_F}, t AS (SELECT id, unnest({_tokens('text')}) AS term FROM f) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM t GROUP BY term",
    "clause_modality": f"SELECT DISTINCT id, {_modality('text')} AS own, {_lead_modality('lead_in')} AS inherited, coalesce({_modality('text')}, {_lead_modality('lead_in')}, 'neutral') AS modality FROM clauses",
    "template_filter": f"SELECT DISTINCT id, {_template_r('text')} AS for_retrieval, {_template_d('text')} AS for_duplicates FROM org_functions",
    "verb_signature": f"SELECT DISTINCT id, {_class('text')} AS verb_class, {_object('text')} AS object_head, {_usable(f"({_class('text')} || '|' || {_object('text')})")} AS signature FROM org_functions",
    "doc_kind": r"SELECT id, CASE WHEN contains(lower(name), 'положение') THEN 'polozhenie' WHEN contains(lower(name), 'должностн') THEN 'di' WHEN contains(lower(name), 'приказ') THEN 'order' ELSE 'other' END AS kind, right(regexp_replace(regexp_extract(name, '([^/\\]*)$', 1), '[^\p{L}\p{N}._-]+', '_', 'g'), 120) AS file_name FROM regulations",
    "content_hash_ids": "SELECT DISTINCT id, sha256(text) AS sha256, left(sha1(text), 12) AS short_id, string_split(id, ':')[1] AS prefix FROM clauses",
    "number_algebra": rf"""SELECT DISTINCT number, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\.[^.]*$', '') END AS parent, array_to_string({_ancestors('number')}, ' ') AS ancestors,
        array_to_string(list_sort(CASE WHEN len(d) = 0 THEN [] ELSE list_append(list_transform(range(1, len(d) + 1), lambda k: array_to_string(list_append(d[1:k - 1], CAST(CAST(d[k] AS INT) + 1 AS VARCHAR)), '.')), array_to_string(d, '.') || '.1') END), ' ') AS successors,
        {_number_key('number')} AS key FROM (SELECT number, list_filter(string_split(number, '.'), lambda s: regexp_matches(s, '^\d+$')) AS d FROM clauses WHERE number IS NOT NULL)""",
    "unit_name_key": rf"""WITH x AS (SELECT DISTINCT id, name, regexp_extract_all(name, '\((?:[Дд]алее\s*[-–—]?\s*)?([А-ЯЁA-Z][А-ЯЁA-Z0-9\-]{{1,11}})\)', 1) AS inside, regexp_replace(name, '^[ .,;:]+|[ .,;:]+$', '', 'g') AS bare FROM units WHERE name IS NOT NULL)
        SELECT DISTINCT id, {_unit_key('name')} AS key, CASE WHEN len(inside) > 0 THEN inside[-1] WHEN regexp_matches(bare, '^[А-ЯЁA-Z][А-ЯЁA-Z0-9\-]{{1,11}}$') THEN bare END AS abbreviation FROM x""",
    "exclusion_reason": rf"""SELECT DISTINCT id, CASE WHEN modality = 'prohibition' THEN 'prohibition' WHEN unit_id IS NULL THEN 'no unit' WHEN {_template_d('text')} THEN 'template'
        WHEN regexp_matches({_norm('text')}, '(?:^|[^\p{{L}}])(?:участ|содейств|соисполн|помога)') THEN 'participation' WHEN regexp_matches({_norm('text')}, '(?:^|[^\p{{L}}])на (?:согласовани|утверждени|подписани|рассмотрени)') THEN 'for approval' END AS reason FROM org_functions""",
    "json_props": "SELECT event_type, count(*) AS n, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "bm25_topk": f"WITH {_bm25('s', 'documents', 'doc_id', _tokens('text'), 'eval_items', 'item_id', _tokens('text'))} SELECT query AS item_id, id AS doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5",
    "exact_text_groups": f"WITH k AS (SELECT DISTINCT id, version, {_key('text')} AS key FROM org_functions) SELECT min(id) AS first_id, count(*) AS n, count(*) FILTER (version = 'before') AS n_before FROM k GROUP BY key HAVING count(*) > 1",
    "signature_groups": f"WITH k AS (SELECT DISTINCT id, unit_id, {_usable('signature')} AS signature FROM org_functions) SELECT signature, count(*) AS n_functions, count(DISTINCT unit_id) AS n_units FROM k WHERE signature IS NOT NULL GROUP BY signature",
    "signature_partners": f"WITH k AS (SELECT DISTINCT id, unit_id, {_usable('signature')} AS s FROM org_functions) SELECT id, count(*) OVER (PARTITION BY s) - count(*) OVER (PARTITION BY s, unit_id) AS n_other_unit FROM k WHERE s IS NOT NULL AND unit_id IS NOT NULL AND id IS NOT NULL",
    "cosine_topk": """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        s AS (SELECT q.id AS vec_id, c.id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 9) AS s FROM e q JOIN e c ON q.id % 50 = 0 AND q.id <> c.id)
        SELECT vec_id, id, round(s, 6) AS cosine, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 20""",
    "rrf_topk": f"WITH {_SIDES}, qb AS (SELECT * FROM fb WHERE {_ASK}), {_rank('w', 'qb', 'fa')} SELECT query AS before_id, id AS after_id, CASE WHEN isinf(score) THEN 'Infinity' ELSE CAST(round(score, 6) AS VARCHAR) END AS score, reasons, CAST(rank AS INT) AS rank FROM w",
    "reverse_augment": f"WITH {_SIDES}, {_AUGMENT} SELECT query AS before_id, id AS after_id, CAST(kind AS INT) AS kind, CAST(row_number() OVER (PARTITION BY query ORDER BY kind, fr, id) AS INT) AS rank FROM m QUALIFY rank <= 5",
    "dup_pairs_cross_unit": f"""WITH {_F}, k AS (SELECT DISTINCT id, {_strip('text')} AS text, signature, unit_id, version FROM f WHERE modality <> 'prohibition' AND unit_id IS NOT NULL AND NOT {_template_r('text')}),
        kb AS (SELECT * FROM k WHERE version = 'before'), ka AS (SELECT * FROM k WHERE version = 'after'), qb AS (SELECT * FROM kb WHERE {_ASK}), qa AS (SELECT * FROM ka WHERE {_ASK}),
        {_rank('w', 'qb', 'kb', 'qu.unit_id <> cu.unit_id AND x.query <> x.id')}, {_rank('z', 'qa', 'ka', 'qu.unit_id <> cu.unit_id AND x.query <> x.id')},
        pr AS (SELECT DISTINCT least(query, id) AS a, greatest(query, id) AS b FROM (SELECT query, id FROM w UNION ALL SELECT query, id FROM z)), t AS (SELECT id, list_distinct({_tokens('text')}) AS t FROM k)
        SELECT a, b, round({_jaccard('x.t', 'y.t')}, 3) AS similarity FROM pr JOIN t x ON x.id = a JOIN t y ON y.id = b""",
    "link_similarity": f"""WITH {_P}, {_F}, t AS (SELECT DISTINCT id, {_key('text')} AS k, list_distinct({_tokens('text')}) AS t, list_distinct(list_transform(list_filter(regexp_extract_all({_norm('text')}, '[а-яa-z0-9-]+'), lambda w: length(w) > 2), lambda w: {_rule_stem('w')})) AS s FROM f)
        SELECT before_id, after_id, round(CASE WHEN x.k = y.k THEN 1.0 ELSE {_jaccard('x.t', 'y.t')} END, 3) AS tokens, round({_jaccard('x.s', 'y.s')}, 3) AS stems FROM p JOIN t x ON x.id = before_id JOIN t y ON y.id = after_id""",
    "object_overlap": f"""WITH {_P}, {_F}, h AS (SELECT DISTINCT id, {_object('text')} AS h FROM f), t AS (SELECT id, h, list_distinct(list_transform(list_filter(string_split(h, ' '), lambda w: w <> ''), lambda w: {_rule_stem('w')})) AS w FROM h)
        SELECT before_id, after_id, round(CASE WHEN x.h = y.h AND x.h <> '' THEN 1.0 WHEN len(list_intersect(x.w, y.w)) = 0 THEN 0.0 WHEN least(len(x.w), len(y.w)) >= 2 THEN len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)) ELSE {_jaccard('x.w', 'y.w')} END, 6) AS overlap
        FROM p JOIN t x ON x.id = before_id JOIN t y ON y.id = after_id""",
    "verdict_left_join": f"""WITH {_F}, b AS (SELECT DISTINCT id AS before_id FROM f WHERE version = 'before'),
        l AS (SELECT before_id, decision FROM links WHERE before_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY before_id ORDER BY loaded_at DESC, recorded_at DESC, decision, array_to_string(list_transform(after_ids, lambda x: coalesce(x, '?')), ',') NULLS FIRST) = 1)
        SELECT before_id, decision, decision IS NOT NULL AS answered FROM b LEFT JOIN l USING (before_id)""",
    "call_budget": """WITH v AS (SELECT before_id, array_to_string(list_transform(after_ids, lambda x: coalesce(x, '?')), ',') AS ids, decision, verification, min(loaded_at) AS t0 FROM links WHERE before_id IS NOT NULL GROUP BY ALL),
        k AS (SELECT before_id || '|' || coalesce(ids, '-') || '|' || decision || '|' || verification AS key, t0, CAST(CASE WHEN verification = 'exact' THEN 0 WHEN decision = 'none' THEN 2 ELSE 1 END AS BIGINT) AS calls FROM v),
        s AS (SELECT key, calls, CAST(coalesce(sum(calls) OVER (ORDER BY t0, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM k)
        SELECT key, calls, before, calls = 0 OR before + calls <= 400 AS allowed FROM s""",
    "link_components": f"WITH RECURSIVE {_V}, {_GROUPS} SELECT member_id, group_id FROM g",
    "match_status": f"""WITH RECURSIVE {_V}, {_F}, {_GROUPS}, m AS (SELECT DISTINCT group_id, member_id, version FROM g JOIN f ON f.id = member_id),
        n AS (SELECT group_id, count(*) FILTER (version = 'before') AS n_before, count(*) FILTER (version = 'after') AS n_after FROM m GROUP BY group_id),
        d AS (SELECT group_id, max(CAST(decision = 'partial' AS INT)) AS p, max(CAST(decision = 'merge' AS INT)) AS m, min(decision) AS decision, bool_and(verification = 'exact') AS x, min(confidence) AS confidence FROM v JOIN g ON g.member_id = before_id WHERE decision <> 'none' GROUP BY group_id),
        k AS (SELECT *, CASE WHEN n_before > 1 THEN 'merge' WHEN p = 1 THEN 'partial' WHEN n_after > 1 THEN 'split' WHEN m = 1 THEN 'merge' ELSE 'one_to_one' END AS kind FROM n JOIN d USING (group_id))
        SELECT group_id, n_before, n_after, kind, CASE WHEN kind <> 'one_to_one' OR decision = 'split' THEN 'changed' ELSE decision END AS status, CASE WHEN x THEN 'exact' ELSE 'llm' END AS verification, confidence FROM k""",
    "uncovered_before": f"WITH {_V}, {_F}, {_LOST} SELECT before_id FROM lost",
    "new_after": f"WITH {_P}, {_F}, {_NEW} SELECT after_id FROM new",
    "exact_links": f"""WITH {_F}, k AS (SELECT DISTINCT id, version, modality, unit_id, {_key('text')} AS key FROM f WHERE modality <> 'prohibition' AND {_key('text')} <> ''),
        n AS (SELECT *, row_number() OVER (PARTITION BY version, key, modality, unit_id ORDER BY id) AS nth FROM k WHERE unit_id IS NOT NULL),
        kept AS (SELECT b.id AS before_id, a.id AS after_id FROM n b JOIN n a ON b.version = 'before' AND a.version = 'after' AND a.key = b.key AND a.modality = b.modality AND a.unit_id = b.unit_id AND a.nth = b.nth),
        ob AS (SELECT key, modality, min(id) AS id FROM n WHERE version = 'before' AND id NOT IN (SELECT before_id FROM kept) GROUP BY 1, 2 HAVING count(*) = 1),
        oa AS (SELECT key, modality, min(id) AS id FROM n WHERE version = 'after' AND id NOT IN (SELECT after_id FROM kept) GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT before_id, after_id, 'kept' AS decision FROM kept UNION ALL SELECT ob.id, oa.id, 'moved' FROM ob JOIN oa USING (key, modality)""",
    "owner_relation": f"""WITH {_P}, {_F}, {_U}, {_CHANGES}, k AS (SELECT DISTINCT id, unit_id, executor FROM f)
        SELECT p.before_id, p.after_id, CASE WHEN x.unit_id = y.unit_id OR ch.status = 'kept' THEN 'same' WHEN x.unit_id IS NOT NULL AND y.unit_id IS NOT NULL THEN 'different'
        WHEN {_key('x.executor')} = {_key('y.executor')} AND ({_key('x.executor')} <> '' OR (x.unit_id IS NULL AND y.unit_id IS NULL)) THEN 'same' ELSE 'unknown' END AS relation
        FROM p JOIN k x ON x.id = p.before_id JOIN k y ON y.id = p.after_id LEFT JOIN ch ON ch.status = 'kept' AND ch.before_id = x.unit_id AND ch.after_id = y.unit_id""",
    "constraint_pairs": f"WITH {_F}, k AS (SELECT DISTINCT id, unit_id, modality, {_object('text')} AS object FROM f) SELECT x.id AS function_id, y.id AS constraint_id FROM k x JOIN k y ON x.object = y.object AND x.object <> '' AND x.modality <> 'prohibition' AND y.modality = 'prohibition' AND (y.unit_id IS NULL OR y.unit_id = x.unit_id)",
    "rule_specificity": f"WITH {_V}, k AS (SELECT DISTINCT before_id, decision FROM v WHERE before_id IS NOT NULL) SELECT before_id, decision FROM k QUALIFY row_number() OVER (PARTITION BY before_id ORDER BY list_position(['merge', 'split', 'partial', 'moved', 'changed', 'kept', 'none'], decision)) = 1",
    "unit_changes": f"WITH {_U}, {_CHANGES} SELECT before_id, after_id, status FROM ch",
    "unit_lca": _UNITS + f""" , {_P}, {_F}, k AS (SELECT DISTINCT id, unit_id FROM f), up2 AS (SELECT DISTINCT b.unit_id AS unit_b, a.unit_id AS unit_a FROM p JOIN k b ON b.id = before_id JOIN k a ON a.id = after_id WHERE b.unit_id IS NOT NULL AND a.unit_id IS NOT NULL),
        okc AS (SELECT * FROM chain WHERE id NOT IN (SELECT id FROM never)), cm AS (SELECT unit_b, unit_a, x.a, x.d FROM up2 JOIN okc x ON x.id = unit_b JOIN okc y ON y.id = unit_a AND y.a = x.a)
        SELECT up2.unit_b, up2.unit_a, min_by(cm.a, cm.d) AS ancestor_id FROM up2 LEFT JOIN cm ON cm.unit_b = up2.unit_b AND cm.unit_a = up2.unit_a GROUP BY 1, 2""",
    "clause_lookup": f"""WITH {_C}, {_Q}, r AS (SELECT DISTINCT citation_id AS request_id, doc_id, coalesce(clause_number, clause_id) AS wanted FROM q),
        k AS (SELECT doc_id, {_number_key('number')} AS k, id FROM c WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY clause_index, id) = 1), i AS (SELECT DISTINCT doc_id, id FROM c)
        SELECT request_id, coalesce(k.id, i.id) AS clause_id, CASE WHEN k.id IS NOT NULL THEN 'number' WHEN i.id IS NOT NULL THEN 'id' ELSE 'none' END AS how
        FROM r LEFT JOIN k ON k.doc_id = r.doc_id AND k.k = {_number_key('r.wanted')} LEFT JOIN i ON i.doc_id = r.doc_id AND i.id = r.wanted""",
    "number_prefix_closure": f"WITH {_C}, h AS (SELECT doc_id, id, number FROM c WHERE modality = 'prohibition') SELECT doc_id, id FROM h UNION SELECT c.doc_id, c.id FROM c JOIN h ON c.doc_id = h.doc_id AND starts_with(c.number, h.number || '.')",
    "clause_paths": f"""WITH {_C}, {_FIRST}, a AS (SELECT doc_id, id, section, unnest({_ancestors('number')}) AS number FROM c WHERE number IS NOT NULL),
        l AS (SELECT a.id, string_agg(left(first.number || '. ' || first.text, 200), ' / ' ORDER BY length(a.number)) AS labels FROM a JOIN first USING (doc_id, number, section) GROUP BY a.id)
        SELECT id, coalesce(max(section) || coalesce(' / ' || max(labels), ''), '') AS path FROM c LEFT JOIN l USING (id) GROUP BY id""",
    "lead_in_chain": rf"""WITH {_C}, {_FIRST}, a AS (SELECT doc_id, id, section, unnest({_ancestors('number')}) AS number FROM c WHERE number IS NOT NULL),
        j AS (SELECT a.id, length(a.number) AS k, first.number || '. ' || first.text AS label, coalesce(regexp_matches(first.text, ':\s*$'), FALSE) AS colon FROM a LEFT JOIN first USING (doc_id, number, section)),
        o AS (SELECT *, max(CAST(NOT colon AS INT)) OVER (PARTITION BY id ORDER BY k DESC) AS broken FROM j), g AS (SELECT id, string_agg(label, ' ' ORDER BY k) AS lead_in_chain FROM o WHERE broken = 0 GROUP BY id)
        SELECT DISTINCT c.id, lead_in_chain FROM c LEFT JOIN g USING (id)""",
    "provenance_dangling": f"WITH {_Q} SELECT DISTINCT citation_id, clause_id FROM q WHERE clause_id NOT IN (SELECT id FROM clauses WHERE id IS NOT NULL)",
    "quote_verbatim": f"""WITH {_C}, {_Q}, x AS (SELECT DISTINCT citation_id, clause_id, quote FROM q), y AS (SELECT DISTINCT id, list_filter([text, lead_in], lambda t: t IS NOT NULL) AS texts FROM c)
        SELECT citation_id, bool_or({_quote('quote')} <> '' AND len(list_filter(texts, lambda t: contains({_quote('t')}, {_quote('quote')}))) > 0) AS verbatim FROM x JOIN y ON y.id = x.clause_id GROUP BY citation_id""",
    "merge_sources": f"WITH {_Q}, {_MERGED} SELECT citation_id, owner_kind, owner_id, doc_id, clause_id, CAST(place AS INT) AS place FROM m",
    "top_sources": f"WITH {_Q}, {_MERGED}, k AS (SELECT *, greatest(count(*) OVER (PARTITION BY owner_kind, owner_id) - 3, 0) AS more FROM m) SELECT owner_kind, owner_id, CAST(place AS INT) AS place, clause_id, more FROM k WHERE place <= 3",
    "all_sources": f"WITH {_Q}, k AS (SELECT DISTINCT doc_id, clause_id, quote FROM q) SELECT doc_id, count(*) AS n_sources, count(DISTINCT clause_id) AS n_clauses FROM k GROUP BY doc_id",
    "report_stats": f"""WITH {_P}, {_F}, {_LOST}, {_NEW} SELECT 'units_before' AS stat, count(DISTINCT id) AS value FROM units WHERE version = 'before' UNION ALL SELECT 'units_after', count(DISTINCT id) FROM units WHERE version = 'after'
        UNION ALL SELECT 'functions_before', count(DISTINCT id) FROM f WHERE version = 'before' UNION ALL SELECT 'functions_after', count(DISTINCT id) FROM f WHERE version = 'after'
        UNION ALL SELECT 'matches', count(*) FROM v WHERE decision <> 'none' UNION ALL SELECT 'lost', count(*) FROM lost UNION ALL SELECT 'new', count(*) FROM new
        UNION ALL SELECT 'duplicates', 0 UNION ALL SELECT 'conflicts', 0 UNION ALL SELECT 'unverified_candidates', count(*) FROM v WHERE verification = 'llm' AND confidence < 0.5""",
    "facts_numbering": f"""WITH {_P}, {_F}, {_U}, {_CHANGES}, {_LOST}, {_NEW}, a AS (SELECT 'units' AS category, 1 AS c, coalesce(before_id, after_id) AS key FROM ch WHERE status <> 'kept' UNION ALL SELECT 'lost', 2, before_id FROM lost UNION ALL SELECT 'new', 3, after_id FROM new)
        SELECT category, key, 'F' || row_number() OVER (ORDER BY c, key) AS ref FROM a""",
    "facet_counts": f"WITH {_V} SELECT decision, verification, count(*) AS n, round(avg(confidence), 6) AS confidence FROM v GROUP BY 1, 2",
    "md_rows": f"WITH {_Q} SELECT citation_id, '| ' || {_CELL('doc_name')} || ' | ' || {_CELL('version')} || ' | ' || {_CELL('clause_number')} || ' | ' || {_CELL('quote')} || ' |' AS line FROM q",
    "source_labels": f"WITH {_Q} SELECT DISTINCT citation_id, doc_name || ' / ' || version || ' / ' || coalesce(clause_number, '-') || ' / ' || quote AS label FROM q WHERE quote IS NOT NULL",
    "late_arrivals": "SELECT strftime(recorded_at, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (loaded_at > recorded_at + INTERVAL 5 DAY) AS late, count(*) FILTER (loaded_at < recorded_at) AS early FROM org_functions WHERE id IS NOT NULL AND recorded_at IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1",
    "stream_arrivals": "SELECT strftime(recorded_at, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT DISTINCT id, recorded_at FROM org_functions WHERE id IS NOT NULL AND recorded_at IS NOT NULL) GROUP BY 1",
    "function_scope": rf"""WITH {_C}, r AS (SELECT *, coalesce(regexp_matches(lower(section), 'функци|задач|обязанност|полномочи'), FALSE) AS hit FROM c WHERE number IS NOT NULL AND section IS DISTINCT FROM number || '. ' || text AND regexp_matches(text, '\p{{L}}')),
        k AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS in_scope FROM r) SELECT doc_id, count(*) AS n_clauses, count(DISTINCT section) AS n_sections FROM k WHERE hit OR NOT in_scope GROUP BY doc_id""",
    "owner_groups": f"WITH {_F}, k AS (SELECT id, coalesce(unit_id, CASE WHEN {_key('executor')} <> '' THEN 'executor:' || {_key('executor')} END) AS owner FROM f) SELECT owner, count(DISTINCT id) AS n_functions FROM k WHERE owner IS NOT NULL GROUP BY owner",
}


from clauseflow.plans.decision_oracle import DECISIONS  # noqa: E402

ORACLE |= DECISIONS
