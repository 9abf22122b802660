import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clauseflow.operators import decisions as D
from clauseflow.operators import mentions as M
from clauseflow.operators import performers, retrieval, units
from clauseflow.plans.steps import run_steps, within
from clauseflow.sources import answers


def rows(df):
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()}


def test_checked_verdicts(spark):
    v = spark.createDataFrame([("b1", ["a1"], "kept"), ("b2", ["a9", "a2", "a2", None], "split"), ("b3", [], "none"), ("b4", ["a9"], "changed"), ("b6", None, "kept")], "before_id string, after_ids array<string>, decision string")
    shown = spark.createDataFrame([("b1", "a1"), ("b1", "a1"), ("b2", "a2"), ("b2", "a3"), ("b3", "a1"), ("b4", "a1"), ("b5", "a1"), ("b6", "a1")], "before_id string, after_id string")
    texts = spark.createDataFrame([("b1", "Ведёт учёт."), ("a1", "1. ведет учет"), ("b2", "x"), ("a2", "x")], "id string, text string")
    got = {r.before_id: (r.outcome, r.after_ids, r.verification, r.confidence) for r in D.checked_verdicts(v, shown, texts).collect()}
    assert got == {"b1": ("link", ["a1"], "exact", 1.0), "b2": ("link", ["a2"], "llm", 0.8), "b3": ("none", None, None, None), "b4": ("failure", None, None, None), "b5": ("failure", None, None, None), "b6": ("failure", None, None, None)}
    assert D.checked_verdicts(v.limit(0), shown.limit(0), texts).count() == 0


def test_components_and_assignment(spark):
    members = spark.createDataFrame([("g1", "b1", "before"), ("g1", "a1", "after"), ("g2", "b2", "before"), ("g2", "a2", "after"), ("g3", "b3", "before"), ("g3", "a3", "after"), ("g3", "a4", "after"), ("g4", "b4", "before"), ("g4", "a5", "after")], "group_id string, member_id string, version string")
    links = spark.createDataFrame([("g1", 1, "kept", "exact", 1.0), ("g1", 2, "changed", "llm", 0.8), ("g2", 1, "moved", "llm", 0.9), ("g3", 1, "split", "llm", 0.8), ("g4", 1, "changed", "llm", None)], "group_id string, place int, decision string, verification string, confidence double")
    rel = spark.createDataFrame([("g1", "different"), ("g2", "same"), ("g3", "unknown"), ("g4", "unknown")], "group_id string, relation string")
    who = spark.createDataFrame([("g4", "before", "Отдел"), ("g4", "after", "отдел"), ("g2", "before", "А"), ("g2", "after", "Б"), ("g3", "before", None)], "group_id string, version string, executor string")
    a = D.assignment(rel, who)
    assert rows(a) == {("g1", "moved"), ("g2", "executor"), ("g3", "unknown"), ("g4", "unknown")}
    got = {r.group_id: (r.kind, r.status, r.verification) for r in D.component_summary(members, links, a).collect()}
    assert got == {"g1": ("one_to_one", "moved", "llm"), "g2": ("one_to_one", "changed", "llm"), "g3": ("split", "changed", "llm"), "g4": ("one_to_one", "changed", "llm")}


def test_losses_and_new(spark):
    losses = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",), ("b4",)], "before_id string")
    shown = spark.createDataFrame([("b1", "1.2"), ("b2", "1.2")], "before_id string, number string")
    v = spark.createDataFrame([("b1", True, " 1.2 "), ("b2", True, "9.9"), ("b3", False, None)], "before_id string, lost boolean, nearest_number string")
    got = {r.before_id: (r.verified, r.confidence, r.why) for r in D.confirmed_losses(losses, shown, v).collect()}
    assert got == {"b1": (True, 0.85, None), "b2": (False, 0.4, "clause not shown"), "b3": (False, 0.4, "not confirmed"), "b4": (False, 0.4, "no verdict")}
    after = spark.createDataFrame([("a1",), ("a2",), ("a3",), ("a4",)], "after_id string")
    linked = spark.createDataFrame([("a1",)], "after_id string")
    nearest = spark.createDataFrame([("a2", "b1"), ("a3", "b1")], "after_id string, before_id string")
    reviews = spark.createDataFrame([("b1", "a2", "llm")], "before_id string, after_id string, how string")
    new = D.new_functions(after, linked, nearest, reviews)
    assert rows(new.select("after_id", "verified", "verification")) == {("a2", True, "llm"), ("a3", False, "lexical"), ("a4", True, "lexical")}
    f = spark.createDataFrame([("b1", "before"), ("b9", "before"), ("a1", "after"), ("a2", "after")], "id string, version string")
    comp, mem = spark.createDataFrame([("g", "kept")], "group_id string, status string"), spark.createDataFrame([("a1", "g")], "member_id string, group_id string")
    lost = D.confirmed_losses(losses, shown, v)
    assert rows(D.every_function_once(f, comp, mem, new, lost)) == {("b1", "before", "lost", True), ("b9", "before", "lost", False), ("a1", "after", "kept", True), ("a2", "after", "new", True)}


def test_duplicates(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("c", "d", 0.7), ("e", "f", 0.6)], "a string, b string, similarity double")
    v = spark.createDataFrame([("a", "b", True, True, True, True), ("a", "c", False, False, False, False), ("c", "d", True, True, False, True), ("e", "f", True, True, True, True)], "a string, b string, is_duplicate boolean, same_action boolean, same_object boolean, both_executors boolean")
    got = {(r.a, r.b): r.verified for r in D.find_duplicates(pairs, v, limit=3).collect()}
    assert got == {("a", "b"): True, ("c", "d"): False, ("e", "f"): False}  # e, f is beyond the budget


def test_gate_keeps_what_every_side_proves(spark):
    c = spark.createDataFrame([(1, "function", "b1", "d1", "before"), (2, "function", "a1", "d2", "after"), (3, "function", "b2", "d1", "after"), (4, "function", "a2", "d2", "after")], "citation_id long, owner_kind string, owner_id string, doc_id string, version string")
    docs = spark.createDataFrame([("d1", "before"), ("d2", "after")], "id string, version string")
    checked = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "ok"), (4, "quote")], "citation_id long, status string")
    sources = D.valid_sources(c, None, docs, checked)
    assert {r.citation_id for r in sources.filter("ok").collect()} == {1, 2}
    f = spark.createDataFrame([("f1", "function", "b1", "before"), ("f1", "function", "a1", "after"), ("f2", "function", "b1", "before"), ("f2", "function", "a2", "after"), ("f3", "function", "b1", "after"), ("f4", "function", "b2", None)], "finding_id string, side_kind string, side_id string, side_version string")
    assert {r.finding_id: r.kept for r in D.gated(f, sources).collect()} == {"f1": True, "f2": False, "f3": False, "f4": False}


def test_conclusion_filters(spark):
    p = spark.createDataFrame([("Итог [F1] и [F2].",), ("Без ссылок.",), ("[F9] чужая",), ("[F3] ясно",), ("[F3] требует проверки",), (None,)], "text string")
    known, open_ = F.array(*[F.lit(x) for x in ("F1", "F2", "F3")]), F.array(F.lit("F3"))
    assert {r.text for r in D.admitted_paragraphs(p, known, open_).collect()} == {"Итог [F1] и [F2].", "[F3] требует проверки"}
    assert {r.text for r in D.admitted_recommendations(p, F.array(F.lit("F1"), F.lit("F2"))).collect()} == {"Итог [F1] и [F2]."}
    df = spark.createDataFrame([("created", None, "a"), ("created", "b", "a"), ("kept", "b", None), ("abolished", "b", None)], "s string, b string, a string")
    assert [r[0] for r in df.select(D.consistent_pair(F.col("s"), F.col("b"), F.col("a"))).collect()] == [True, False, False, True]


UNITS = [("u1", "Отдел закупок (ОЗ)"), ("u2", "Отдел закупок сырья"), ("u3", "Департамент финансов"), ("u4", None), ("u5", "!!!")]


def test_mentions(spark):
    named = spark.createDataFrame(UNITS, "unit_id string, name string")
    texts = spark.createDataFrame([("t1", "Готовит с отделом закупок сырья отчёт"), ("t2", "Работники ОЗ и департамента финансов"), ("t3", "ОЗОН"), ("t4", None), ("t5", "")], "text_id string, text string")
    assert rows(M.mentions(texts, named)) == {("t1", "u1", 3), ("t1", "u2", 3), ("t2", "u1", 2), ("t2", "u3", 4)}
    assert rows(M.abbreviation_hits(texts, named)) == {("t2", "u1")}
    assert M.mentions(texts.limit(0), named).count() == 0 and M.mentions(texts, named.limit(0)).count() == 0


def test_owners(spark):
    tree = spark.createDataFrame([("r", ["r"], 0), ("u1", ["r", "u1"], 1), ("u2", ["r", "u2"], 1), ("x", ["x"], 0)], "unit_id string, path array<string>, depth long")
    texts = spark.createDataFrame([("t1", True), ("t2", True), ("t3", True), ("t4", False), ("t5", False), ("t6", True), ("t7", False)], "text_id string, has_executor boolean")
    own = spark.createDataFrame([("t1", "u1", 1), ("t4", "u2", 1), ("t5", "u1", 1), ("t5", "u2", 1), ("t6", "u1", 1), ("t7", "u1", 1), ("t7", "x", 1)], "text_id string, unit_id string, at int")
    found = spark.createDataFrame([("t1", "u1", 1), ("t1", "u2", 1), ("t2", "u2", 1), ("t3", "u1", 1), ("t3", "u2", 2)], "text_id string, unit_id string, at int")
    got = {r.text_id: (r.owner_id, r.how) for r in M.owners(texts, own, found, tree).collect()}
    assert got == {"t1": ("u1", "narrowed"), "t2": ("u2", "executor"), "t3": ("r", "common"), "t4": ("u2", "text"), "t5": ("r", "common"), "t6": (None, "none"), "t7": (None, "none")}


def test_clauses_beside_functions(spark):
    clauses = spark.createDataFrame([("d", "c1", "1.1", 0, "а" * 700, None, ["1. S"]), ("d", "c2", "1.1", 1, "второй", None, ["3. Структура"]), ("d", "c3", None, 2, "без", None, [])], "doc_id string, id string, number string, clause_index int, text string, lead_in string, section_path array<string>")
    assert rows(M.reference_labels(clauses)) == {("d", "c1", "1.1"), ("d", "c2", "c2"), ("d", "c3", "c3")}
    f = spark.createDataFrame([("f1", "d", ["1.1", "9", "1.1"]), ("f2", "d", []), ("f3", None, None)], "id string, doc_id string, context_clause_numbers array<string>")
    got = M.context_of(f, clauses).collect()
    assert [(r.id, [len(t) for t in r.context]) for r in got] == [("f1", [600, 600])]
    assert {r.id for r in M.structure_clauses(clauses).collect()} == {"c2"}
    cites = spark.createDataFrame([(1, "function", "f1", "1.2.", "Первый:"), (2, "function", "f1", "1.3", " Отдел обязан: "), (3, "function", "f2", None, "x")], "citation_id long, owner_kind string, owner_id string, clause_number string, quote string")
    assert rows(M.lead_in_of(cites)) == {("f1", "Отдел обязан:")}
    assert rows(M.allowed_numbers(f, cites)) == {("f1", ("1.1", "1.2", "1.3", "9"))}
    t = spark.createDataFrame([("t", "d", "см. 1.1. и 2.2, рост 0.85"), ("n", "d", None)], "text_id string, doc_id string, text string")
    assert rows(M.cited_numbers(t, clauses)) == {("t", "1.1", "c1")}
    sel = M.selected_clauses(clauses.withColumn("text", F.lit("Отдел закупок")), spark.createDataFrame([("u9", "c1"), ("u9", "zz")], "unit_id string, clause_id string"), spark.createDataFrame(UNITS, "unit_id string, name string"))
    assert rows(sel) == {("u9", "c1"), ("u1", "c1"), ("u1", "c2"), ("u1", "c3")}


def test_constraints_positions_roots(spark):
    c = spark.createDataFrame([("p1", None, None), ("p2", "u1", None), ("p3", "zz", None), ("p4", "u1", "Работники отдела")], "constraint_id string, unit_id string, executor string")
    o = spark.createDataFrame([("u1",), ("u2",)], "owner string")
    assert rows(M.constraint_scope(c, o)) == {("p1", None), ("p2", "u1"), ("p3", None), ("p4", None)}
    cl = spark.createDataFrame([("d", "c1", "5.3", "Директор направления обязан:", None), ("d", "c2", "5.3.1", "вести учёт", "5.3. Директор направления обязан:"), ("d", "c3", "6", "Куратор информирует совет", None), ("d", "c4", None, "x", "Порядок:")], "doc_id string, id string, number string, text string, lead_in string")
    assert rows(M.positions(cl)) == {("d", "директор направления", "Директор направления", 2)}
    u = spark.createDataFrame([("a", "before", None), ("b", "before", "a"), ("c", "after", " "), ("d", "after", None)], "id string, version string, parent string")
    assert rows(M.unique_roots(u)) == {("before", "a"), ("after", None)}
    found = M.found_units(spark.createDataFrame([("t", "согласует с отделом закупок и Департаментом финансов (ДФ)")], "text_id string, text string"))
    assert {r.key for r in found.collect()} == {"отдел закупок", "департамент финансов"}
    assert rows(M.enriched_units(spark.createDataFrame(UNITS, "unit_id string, name string"), found)) == {("u1", "t"), ("u3", "t")}


def test_act_classes(spark):
    df = spark.createDataFrame([("Разрабатывает и утверждает годовой план аудита",), ("Согласовывает договор",), ("Организует обучение",), (None,)], "t string").select("t", performers.action("t", F.lit(None).cast("string")).alias("a"))
    got = {r.t: (r.strong, r.weak, r.head) for r in df.select("t", performers.act_class(F.col("a.verbs"), "strong").alias("strong"), performers.act_class(F.col("a.verbs"), "weak").alias("weak"), performers.head_word("a.object").alias("head")).collect()}
    assert got["Разрабатывает и утверждает годовой план аудита"] == (True, False, "план") and got["Согласовывает договор"][:2] == (False, True) and got[None] == (False, False, "")


def test_dense_pool_joins_the_fusion(spark):
    schema = "id string, text string, signature string, unit_id string, vector array<double>"
    q = spark.createDataFrame([("q", "ведёт реестр договоров", None, "u", [1.0, 0.0, 0.0])], schema)
    c = spark.createDataFrame([("x", "хранит реестр договоров", None, "v", [0.9, 0.1, 0.0]), ("y", "совсем иное дело", None, "v", [1.0, 0.0, 0.0]), ("z", "прочее занятие", None, "v", [0.0, 1.0, 0.0]), ("w", "без вектора", None, "v", None)], schema)
    got = retrieval.rank_candidates(q, c).orderBy("rank").collect()
    assert [(r.id, r.reasons) for r in got][:2] == [("x", "lexical,dense"), ("y", "dense")]
    assert {r.id for r in retrieval.rank_candidates(q, c, other_unit=True).collect()} == {"x", "y", "z"}


def test_sinks_can_be_read_back(spark, tmp_path):
    (tmp_path / "call").mkdir()
    for k in ("a", "b"):
        (tmp_path / "call" / f"{k}.json").write_text('{"lost": false, "why": "stored"}')
    answers.write_answers(spark.createDataFrame([("b", True, "recorded"), ("c", True, "recorded")], "key string, lost boolean, why string"), str(tmp_path), "call")
    assert rows(answers.all_answers(spark, str(tmp_path), "call", "lost boolean, why string")) == {("a", False, "stored"), ("b", True, "recorded"), ("c", True, "recorded")}
    answers.write_vectors(spark.createDataFrame([("t", [1.0, 2.0]), ("u", []), (None, [1.0])], "text string, vector array<double>"), str(tmp_path / "v"), "m")
    assert [list(r.vector) for r in answers.with_vectors(spark.createDataFrame([("t",)], "text string"), answers.recorded_vectors(spark, str(tmp_path / "v"), "m")).collect()] == [[1.0, 2.0]]
    schema = S.StructType([S.StructField("a", S.StringType()), S.StructField("b", S.ArrayType(S.LongType()))])
    assert answers.strict_schema(schema) == {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "integer"}}}, "required": ["a", "b"], "additionalProperties": False}


def test_steps(spark):
    seen = []
    run = run_steps([("a", [], lambda: 1), ("b", ["a"], lambda a: a / 0), ("c", ["b"], lambda b: b), ("d", ["a"], lambda a: a + 1)], lambda name, r: seen.append(name))
    assert run.results == {"a": 1, "d": 2} and run.missing_steps == ["b", "c"] and run.missing["c"] == "needs b" and seen == ["a", "b", "c", "d"]
    assert within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        within(spark, 0.5, lambda: __import__("time").sleep(5))


def test_numbers_run_over_ranges(spark):
    from clauseflow.operators import report

    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "units").otherwise("lost").alias("category"), F.format_string("%03d", F.col("id")).alias("key")).repartition(7)
    got = sorted(((r.category != "units", r.key), int(r.ref[1:])) for r in report.numbered(df, ["units", "lost"], ["key"]).collect())
    assert [n for _, n in got] == list(range(1, 501))
    assert report.numbered(df.limit(0), ["units"], ["key"]).count() == 0


def test_document_pair(spark):
    import os

    from clauseflow.sources.tables import document_pair

    before, after = document_pair(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    assert before.count() > 0 and after.count() > 0 and before.join(after, "doc_id").count() == 0


def test_shelves_are_cleared(spark):
    from pathlib import Path

    from clauseflow.session import Shelf, clear_shelves

    shelf = Shelf(spark, "clear")
    df, seen = shelf.put_seen(spark.range(5), n=F.count(F.lit(1)), low=F.min("id"))
    at = Path(df._shelf_path.removeprefix("file://"))
    assert seen == {"n": 5, "low": 0} and at.exists()
    assert clear_shelves(spark) >= 1 and not at.exists() and clear_shelves(spark) == 0


def test_parents_by_name(spark):
    df = spark.createDataFrame([("u1", "before", "Отдел закупок", "Департамент финансов"), ("u2", "before", "Департамент финансов (ДФ)", None), ("u3", "after", "Департамент финансов", None)], "id string, version string, name string, up string")
    assert rows(units.parents_by_name(df, "up")) == {("u1", "u2"), ("u2", None), ("u3", None)}
