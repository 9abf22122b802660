"""Queries that must do the whole job, where their SQL or an earlier version does less."""

import os
import random

import duckdb

from clauseflow.operators import hierarchy, retrieval, units
from clauseflow.plans.oracle import ORACLE
from clauseflow.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ASKED = "(('0x' || left(id, 8))::BIGINT % 50 = 0)"


def _sql(text):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con.sql(text)


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_rank_all_equals_rank_candidates(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 50)
    r = random.Random(4)
    words = "отчёт план смета учёт архив закупка договор контроль проверка риск".split()
    rows = [(f"f{k:03d}", " ".join(r.choices(words, k=r.randrange(1, 6))), r.choice([None, "X|отчёт", "X|план", "Y|"]), r.choice([None, "u", "v", "w"])) for k in range(150)]
    rows += [("g0", None, None, "u"), ("g1", "", "X|план", "v"), ("g2", "небывалое", None, "w")]
    df = spark.createDataFrame(rows, "id string, text string, signature string, unit_id string")
    for other in (False, True):
        for k in (1, 5):
            assert _rows(retrieval.rank_all(df, df, k, other_unit=other)) == _rows(retrieval.rank_candidates(df, df, k, other_unit=other))


def test_reverse_augment_searches_from_every_after_function(spark):
    whole = ORACLE["reverse_augment"].replace(f"qa AS (SELECT * FROM fa WHERE {ASKED})", "qa AS (SELECT * FROM fa)")
    assert whole != ORACLE["reverse_augment"]
    want = _sql(f"SELECT * FROM ({whole}) WHERE {ASKED.replace('id', 'before_id')}")
    got = QUERIES["reverse_augment"](spark, DATA).select(*want.columns)
    assert _rows(got) == sorted(tuple(map(str, x)) for x in want.fetchall())


def test_units_merge_within_a_version_before_they_match(spark):
    rows = [
        ("b1", "Отдел учёта", "before", None), ("b2", "отдел  учета", "before", "b1"), ("b3", "Отдел закупок (ОЗК)", "before", "b2"), ("b4", "ОЗК", "before", None), ("b5", "Отдел связи", "before", "b4"), ("b6", None, "before", "x9"),
        ("a1", "ОЗК", "after", None), ("a2", "Отдел учёта", "after", " "), ("a3", "Отдел архива", "after", "a1"), ("a4", None, "after", None),
    ]
    df = spark.createDataFrame(rows, "id string, name string, version string, parent string")
    m = units.merged_units(df)
    assert {x.id: x.unit_id for x in m.collect()} == {i: {"b2": "b1", "b4": "b3"}.get(i, i) for i, *_ in rows}
    got = {tuple(x) for x in units.unit_changes(df).collect()}
    assert got == {("b1", "a2", "kept"), ("b3", "a1", "kept"), ("b5", None, "abolished"), ("b6", None, "abolished"), (None, "a3", "created"), (None, "a4", "created")}
    parents = {x.unit_id: x.parent for x in units.merged_parents(df, m).collect()}
    assert parents == {"b1": None, "b3": "b1", "b5": "b3", "b6": "x9", "a1": None, "a2": None, "a3": "a1", "a4": None}
    named = df.withColumn("over", units.F.when(units.F.col("id") == "b5", "отдел закупок").when(units.F.col("id") == "b1", "Отдел учёта").when(units.F.col("id") == "a3", "ОЗК"))
    assert {x.id: x.parent_id for x in units.parents_by_name(named, "over").collect() if x.parent_id} == {"b5": "b3", "b1": "b2", "a3": "a1"}


def test_unit_changes_lists_a_name_once_a_version(spark):
    keys = "SELECT id, key FROM (" + ORACLE["unit_name_key"] + ") WHERE key <> ''"
    assert _sql(f"SELECT count(*) FROM (SELECT key FROM ({keys}) k JOIN units u ON u.id = k.id GROUP BY version, key HAVING count(DISTINCT u.id) > 1)").fetchall()[0][0] > 0
    key = dict(_sql(keys).fetchall())
    rows = QUERIES["unit_changes"](spark, DATA).collect()
    for ids in ([x.before_id for x in rows], [x.after_id for x in rows]):
        named = [key[i] for i in ids if i in key]
        assert len(named) == len(set(named))
    gone, new = ({key[i] for x in rows if x.status == s and (i := x[at]) in key} for s, at in (("abolished", 0), ("created", 1)))
    assert not gone & new


def test_descendants_below_a_circle(spark, tmp_path):
    rows = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", "d"), ("self", "self"), ("f", "self"), ("r", None), ("s", "r")]
    spark.createDataFrame(rows, "id string, parent string").write.parquet(str(tmp_path / "units.parquet"))
    got = {tuple(x) for x in QUERIES["p1_descendants"](spark, str(tmp_path)).collect()}
    assert got == {("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("c", "d", 1), ("c", "e", 2), ("d", "e", 1), ("self", "f", 1), ("r", "s", 1)}
    sizes = {x.unit_id: x.subtree_size for x in hierarchy.hierarchy(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert sizes == {i: 1 + sum(a == i for a, *_ in got) for i, _ in rows}


def test_dup_pairs_rank_every_function(spark):
    whole = ORACLE["dup_pairs_cross_unit"].replace(f" WHERE {ASKED}", "")
    assert whole != ORACLE["dup_pairs_cross_unit"]
    want = _sql(whole)
    got = QUERIES["dup_pairs_cross_unit"](spark, DATA).select(*want.columns)
    assert _rows(got) == sorted(tuple(map(str, x)) for x in want.fetchall())


def test_rrf_topk_writes_no_row_a_pair(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    words = [f"слово{k}" for k in range(40)]
    rows = [(f"{50 * k:08x}aaaa", f"u{k % 7}", v, "общее " + " ".join(r.choices(words, k=4)), "task", "duty", None, r.choice([None, "X|план", "Y|смета"])) for v in ("before", "after") for k in range(150)]
    spark.createDataFrame(rows, "id string, unit_id string, version string, text string, category string, modality string, executor string, signature string").write.parquet(str(tmp_path / "org_functions.parquet"))
    put, written = retrieval.Shelf.put, []
    monkeypatch.setattr(retrieval.Shelf, "put", lambda self, df: (out := put(self, df), written.append(out.count()))[0])
    got = QUERIES["rrf_topk"](spark, str(tmp_path))
    assert got.count() == 150 * 5 and max(written) < 150 * 150 // 2
    f = spark.read.parquet(str(tmp_path / "org_functions.parquet"))
    want = retrieval.rank_candidates(f.filter("version = 'before'"), f.filter("version = 'after'"))
    assert _rows(got.select("before_id", "after_id", "score", "reasons", "rank")) == _rows(want)


def test_a_query_is_not_compared_with_every_row_of_a_block():
    class Id(str):
        seen = 0
        __hash__ = str.__hash__

        def __eq__(self, other):
            Id.seen += 1
            return str.__eq__(self, other)

    n = 300
    block = retrieval.pd.DataFrame({"unit": [f"u{k % 9}" for k in range(n)], "key": None, "sig": None, "mates": False, "terms": [retrieval.np.array([k % 11, 20]) for k in range(n)], "weights": [retrieval.np.array([1.0, 0.1])] * n})
    ids = [f"{k:04d}" for k in range(n)]
    corpus = block.assign(id=retrieval.pd.Series([Id(i) for i in ids], dtype=object))
    queries = block.rename(columns={"unit": "query_unit"}).assign(query=retrieval.pd.Series(ids, dtype=object))
    got = retrieval._block_pools(queries, corpus, 5, 20, True)
    assert len(got) == 5 * n and not (got["query"] == got["id"].map(str)).any()
    assert Id.seen < n * n // 2
