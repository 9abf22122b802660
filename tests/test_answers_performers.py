import hashlib
import json

from clauseflow.operators import performers as P
from clauseflow.sources import answers


def test_answers_and_rejects(spark, tmp_path):
    (tmp_path / "call").mkdir()
    for name, text in (("a", '{"lost": true, "why": "x"}'), ("b", '{"lost": true}'), ("c", '{"lost": true, "why": "x", "more": 1}'), ("d", "no json"), ("e", '{"lost": "maybe", "why": "x"}')):
        (tmp_path / "call" / f"{name}.json").write_text(text)
    good, bad = answers.read_answers(spark, str(tmp_path), "call", "lost boolean, why string")
    assert [tuple(r) for r in good.collect()] == [("a", True, "x")]
    assert {r.key: r.reason for r in bad.collect()} == {"b": "fields", "c": "fields", "d": "no JSON object", "e": "type"}
    answers.write_answers(good, str(tmp_path), "out")
    assert spark.read.json(f"{tmp_path}/out-lines").count() == 1


def test_vectors(spark, tmp_path):
    sha = hashlib.sha256("текст".encode()).hexdigest()
    (tmp_path / f"{sha}.json").write_text(json.dumps({"model": "m", "text_sha256": sha, "vector": [1.0, 0.5]}))
    (tmp_path / "wrong.json").write_text(json.dumps({"model": "m", "text_sha256": sha, "vector": [9.0]}))
    df = spark.createDataFrame([("текст",), ("иной",), (None,)], "text string")
    got = {r.text: r.vector for r in answers.with_vectors(df, answers.read_vectors(spark, str(tmp_path), "m")).collect()}
    assert got == {"текст": [1.0, 0.5], "иной": None, None: None}


def test_run_store(spark, tmp_path):
    answers.put_run(spark, str(tmp_path), "r1", {"progress": 5})
    answers.put_run(spark, str(tmp_path), "r1", {"progress": 100, "state": "done"}, spark.range(2).toDF("n"))
    assert answers.get_run(spark, str(tmp_path), "r1") == {"progress": 100, "state": "done"}


def test_executor_phrases():
    cases = {
        "5.3. Директор направления обязан:": "Директор направления", "Отдел закупок осуществляет контроль": "Отдел закупок", "В целях контроля, БВА:": "БВА",
        "Порядок работы": None, "": None, None: None, "Начальник отдела (далее – Начальник) вправе:": "Начальник отдела",
    }
    assert {t: P.executor_phrase(t) for t in cases} == cases


def test_inherited_executor(spark):
    rows = [("d", "a", "1", "s", "Директор:", 0, None), ("d", "b", "1.1", "s", "обязан вести:", 1, None), ("d", "c", "1.1.1", "s", "учёт", 2, "Отдел кадров:"), ("d", "e", "2", "s", "архив", 3, "Отдел кадров:"), ("d", "f", None, "s", "x", 4, None)]
    df = spark.createDataFrame(rows, "doc_id string, id string, number string, section string, text string, clause_index int, lead_in string")
    assert {r.id: r.executor for r in P.inherited_executors(df).collect()} == {"a": None, "b": "Директор", "c": "Директор", "e": "Отдел кадров", "f": None}


def test_scope_falls_back_to_all(spark):
    rows = [("d", "1.1", "1. ФУНКЦИИ", "учёт"), ("d", "2.1", "2. ИНОЕ", "архив"), ("e", "1.1", "1. ИНОЕ", "опись"), ("e", None, "1. ИНОЕ", "без номера"), ("e", "1", "1. ИНОЕ", "ИНОЕ")]
    df = spark.createDataFrame(rows, "doc_id string, number string, section string, text string")
    assert {r.text for r in P.clauses_in_scope(df, "функци").collect()} == {"учёт", "опись"}


def test_actions(spark):
    a = P.parse_action("Обеспечивает разработку и утверждение регламента закупок согласно плану")
    assert a["aux"] == ["обеспечивает"] and a["verbs"] == ["разработку", "утверждение"] and a["object"] == ["регламента", "закупок"]
    assert P.parse_action("согласует акт проверки", None)["verbs"] == [] or P.parse_action("согласовывает акт проверки")["object"] == ["акт", "проверки"]
    assert P.parse_action(None) == {"aux": [], "verbs": [], "object": []}
    df = spark.createDataFrame([("Отдел ведет реестр, иное", "Отдел"), (None, None)], "t string, p string").select(P.action("t", "p").alias("a"))
    assert [list(r.a["object"] or []) for r in df.collect()] == [["реестр"], []]


def test_owner_groups(spark):
    df = spark.createDataFrame([("u", None), (None, " Отдел "), (None, None), (None, "")], "unit_id string, executor string")
    assert [r.owner for r in P.owner_groups(df).collect()] == ["u", "executor:отдел"]
