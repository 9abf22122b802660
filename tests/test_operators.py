import random

from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.operators import clauses as C
from clauseflow.operators import matching, provenance, report, retrieval
from clauseflow.sources import docx


def test_degree_cap_equals_one_pass(spark):
    r = random.Random(1)
    pairs = {(min(a, b), max(a, b)): r.randrange(5) / 4 for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(170)) if a != b}
    want, used = set(), {}
    for (a, b), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a int, b int, similarity double")
    assert {(x.a, x.b) for x in matching.degree_cap(df, 3).collect()} == want


def test_call_budget_is_a_prefix_sum(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(40)]), f"k{n:03d}", r.randrange(3)) for n in range(150)]
    df = spark.createDataFrame(rows, "at long, key string, calls long")
    got = {x.key: (x.before, x.allowed) for x in matching.call_budget(df, "at", "key", "calls", 50).collect()}
    total = 0
    for at, key, calls in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        assert got[key] == (total, calls == 0 or total + calls <= 50)
        total += calls
    assert matching.call_budget(df.limit(0), "at", "key", "calls", 50).count() == 0


def test_bm25_against_formula(spark):
    import math

    docs = [(1, "отчёт отчёт план"), (2, "план смета"), (3, ""), (4, "реестр")]
    df = spark.createDataFrame(docs, "id long, text string")
    index = retrieval.bm25_index(df, "id", F.split("text", " "))
    got = {(x.query, x.id): x.score for x in retrieval.bm25_scores(spark.createDataFrame([(9, "отчёт план план")], "id long, text string"), "id", F.split("text", " "), index).collect()}
    words = {i: t.split(" ") for i, t in docs}
    mean = sum(map(len, words.values())) / 4
    for i, w in words.items():
        s = 0.0
        for term in ("отчёт", "план"):
            n = sum(term in x for x in words.values())
            if tf := w.count(term):
                s += math.log(1 + (4 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        assert abs(got.get((9, i), 0.0) - s) < 1e-8


def test_fusion_puts_exact_first(spark):
    rows = [("q", "Готовит сводный отчёт о закупках", None, "u"), ("a", "готовит  сводный отчёт о закупках.", None, "u"), ("b", "Готовит отчёт о закупках и сметах", "X|отчёт", "v"), ("c", "Совсем другое дело", None, "v"), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "id string, text string, signature string, unit_id string")
    got = retrieval.rank_candidates(df.filter("id = 'q'"), df.filter("id <> 'q'")).orderBy("rank").collect()
    assert [x.id for x in got][:2] == ["a", "b"] and got[0].reasons == "exact" and got[0].score == float("inf") and got[1].reasons == "lexical"
    other = retrieval.rank_candidates(df, df, other_unit=True)
    assert {(x.query, x.id) for x in other.collect()} >= {("q", "b"), ("b", "q")} and other.filter("query = id").count() == 0


def test_exact_links(spark):
    b = spark.createDataFrame([("b1", "Текст один", "duty", "u1"), ("b2", "текст  один!", "duty", "u1"), ("b3", "Другой", "duty", "u1"), ("b4", "Третий", "duty", None)], "id string, text string, modality string, unit_id string")
    a = spark.createDataFrame([("a1", "Текст один", "duty", "u1"), ("a2", "Другой", "duty", "u2"), ("a3", "Другой", "right", "u1"), ("a4", "Третий", "duty", "u1")], "id string, text string, modality string, unit_id string")
    assert {tuple(x) for x in matching.exact_links(b, a).collect()} == {("b1", "a1", "kept"), ("b3", "a2", "moved")}


def test_clauses(spark):
    rows = [("d", "c0", "1", "1. S", "Отдел:", 0, None, "neutral"), ("d", "c1", "1.2", "1. S", "обязан:", 1, None, "duty"), ("d", "c2", "1.2.3", "1. S", "вести учёт", 2, None, "neutral"), ("d", "c3", "1.20", "1. S", "иное", 3, None, "neutral"), ("d", "c4", None, "1. S", "без номера", 4, None, "neutral"), ("d", "c5", "1.2", "1. S", "повтор", 5, None, "neutral")]
    df = spark.createDataFrame(rows, "doc_id string, id string, number string, section string, text string, clause_index int, lead_in string, modality string")
    assert {x.id: x.lead_in_chain for x in C.lead_in_chain(df).collect()}["c2"] == "1. Отдел: 1.2. обязан:"
    assert {x.id: list(x.path) for x in C.ancestor_labels(df).collect()}["c2"] == ["1. S", "1. Отдел:", "1.2. обязан:"]
    assert {x.id for x in C.prefix_closure(df.filter("id = 'c1'").select("doc_id", "id", "number"), df).collect()} == {"c1", "c2"}
    req = spark.createDataFrame([(1, "d", "1.2."), (2, "d", "c4"), (3, "d", "9")], "request_id int, doc_id string, wanted string")
    assert {tuple(x) for x in C.lookup(req, df).collect()} == {(1, "c1", "number"), (2, "c4", "id"), (3, None, "none")}


def test_citations(spark):
    clauses = spark.createDataFrame([("d", "c1", "1.1", "Отдел:", "ведёт учёт"), ("d", "c2", None, None, "готовит «отчёт»")], "doc_id string, id string, number string, lead_in string, text string")
    rows = [(1, "d", "c1", "1.1", "ведёт учёт"), (2, "d", "c1", "1.1", "отдел: ведёт"), (3, "d", "c1", "1.2", "ведёт учёт"), (4, "d", "c9", "1.1", "x"), (5, "d", "c2", None, 'ГОТОВИТ "отчёт"'), (6, "d", "c2", None, "иное"), (7, "d", "c2", None, None), (7, "d", "c2", None, None)]
    c = spark.createDataFrame(rows, "citation_id long, doc_id string, clause_id string, clause_number string, quote string")
    got = {x.citation_id: x.status for x in provenance.check_citations(c, clauses).collect()}
    assert got == {1: "ok", 2: "ok", 3: "number", 4: "dangling", 5: "ok", 6: "quote", 7: "empty"}


def test_report_parts(spark):
    one = spark.createDataFrame([(3,)], "n long")
    assert {x.stat: x.value for x in report.stats_rows({"lost": one}).collect()} == {k: 3 if k == "lost" else 0 for k in report.REQUIRED_STATS}
    f = spark.createDataFrame([("lost", "z"), ("units", "b"), ("units", "a"), ("other", "q")], "category string, key string")
    assert {x.key: x.ref for x in report.numbered(f, ["units", "lost"], ["key"]).collect()} == {"a": "F1", "b": "F2", "z": "F3"}
    lines = report.markdown_rows(spark.createDataFrame([(1, "a|b", None), (2, "c\nd", "e")], "k int, x string, y string"), "k", ["x", "y"])
    assert {x.k: x.line for x in lines.collect()} == {1: "| a\\|b | — |", 2: "| c d | e |"}
    assert "## T" in report.markdown_document([("T", ["x", "y"], lines)])


def test_specificity_and_verdicts(spark):
    f = spark.createDataFrame([("k", "c"), ("k", "a"), ("m", "zz")], "key string, rule string")
    assert {tuple(x) for x in matching.most_specific(f, "key", "rule", ["a", "b", "c"]).collect()} == {("k", "a"), ("m", "zz")}
    rows = spark.createDataFrame([("x",), ("y",)], "key string")
    v = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "key string, at int, answer string")
    assert {tuple(x) for x in matching.with_verdicts(rows, v, ["key"], [F.desc("at")], "answer").collect()} == {("x", "new", True), ("y", None, False)}


PARAGRAPHS = [
    "ОГЛАВЛЕНИЕ", "1. ОБЩИЕ ПОЛОЖЕНИЯ 3", "1. ОБЩИЕ ПОЛОЖЕНИЯ", "1.1. Отдел подчиняется директору. 1.2. Отдел обязан:", "а) вести учёт;", "б) не допускается выносить дела;", "вести архив;",
    "1.3. Порядок работы.", "2. ФУНКЦИИ", "2.1. Отдел имеет право:", "2.1.1. запрашивать сведения;", "2.1.2. давать ответы.", "просто абзац",
]


def test_docx_reader():
    rows, error = docx.parse_file("dir/Положение_об_отделе.docx", docx.write_docx(PARAGRAPHS), "before")
    assert error is None
    by = {r["number"]: r for r in rows if r["number"]}
    assert list(by) == ["1", "1.1", "1.2", "1.2.а", "1.2.б", "1.3", "2", "2.1", "2.1.1", "2.1.2"]
    assert by["1.1"]["text"] == "Отдел подчиняется директору." and by["1.2.а"]["lead_in"] == "1.2. Отдел обязан:" and by["1.2.а"]["modality"] == "duty"
    assert by["1.2.б"]["modality"] == "prohibition" and by["2.1.1"]["modality"] == "right" and by["2.1.1"]["section"] == "2. ФУНКЦИИ"
    archive = next(r for r in rows if r["text"] == "вести архив;")
    assert archive["lead_in"] == "1.2. Отдел обязан: б. не допускается выносить дела;" or archive["lead_in"] == "1.2. Отдел обязан:"
    assert [r["clause_index"] for r in rows] == list(range(len(rows))) and len({r["id"] for r in rows}) == len(rows)
    assert all(r["section_path"][0] == r["section"] for r in rows) and rows[0]["kind"] == "polozhenie"


def test_docx_rejects(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx.write_docx(PARAGRAPHS))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"1.1. text")
    (tmp_path / "e.docx").write_bytes(docx.write_docx(["без номеров"]))
    got = docx.read_docx(spark, str(tmp_path), "after")
    errors = {x.path.rsplit("/", 1)[-1]: x.error for x in got.filter("error IS NOT NULL").collect()}
    assert errors == {"b.docx": "broken file", "c.docx": "empty file", "d.txt": "not a .docx", "e.docx": "no numbered clause"}
    assert got.filter("error IS NULL AND version = 'after'").count() >= 10


def test_docx_table_rows():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    import io
    import zipfile

    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    xml = f"<w:document {ns}><w:body>{p('1. РАЗДЕЛ')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl><w:tbl><w:tr>{cell('1.1. внутри')}</w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    blocks = docx.read_blocks(out.getvalue())
    assert [(b.address, b.text, b.row) for b in blocks] == [("p0", "1. РАЗДЕЛ", False), ("t0:r0", "a | b", True), ("p1", "1.1. внутри", False)]


def test_columns_and_reader_agree_on_modality(spark):
    texts = ["не вправе", "имеет право и обязан", "обязан, вправе", "ничего", "Не допускается; осуществляет", "невправе обязаны"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.modality("t").alias("m"))
    assert {x.t: x.m for x in df.collect()} == {t: docx.modality(t) for t in texts}
