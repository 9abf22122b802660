import pytest
from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.operators import report, units
from clauseflow.operators.provenance import quoted


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Работник не вправе выносить", "prohibition"), ("имеет право требовать", "right"), ("Обязан вести, а также имеет право:", "right"), ("прочий текст", None), ("", None), (None, None), ("Отдел осуществляет надзор", "duty"), ("имеет право и обязан", "duty"), ("НЕ ДОПУСКАЕТСЯ", "prohibition"), ("вправе, но не вправе", "prohibition"), ("невправе", None)],
)
def test_modality(spark, text, want):
    assert one(spark, T.modality, text) == want


def test_lead_in_prohibition_wins(spark):
    assert one(spark, T.lead_in_modality, "не вправе, но обязан:") == "prohibition"
    assert one(spark, lambda a, b: T.clause_modality(a, b), "просто текст", None) == "neutral"
    assert one(spark, lambda a, b: T.clause_modality(a, b), "обязан", "запрещается:") == "duty"


def test_tokens(spark):
    got = one(spark, T.tokens, "Проверка и проверки ИТ по п. 2.3. с ДЗО, а также учёта")
    assert "2.3" in got and "ит" in got and "дзо" in got and "и" not in got and "также" not in got
    assert got.count("провер") == 2
    assert one(spark, T.tokens, None) == []


@pytest.mark.parametrize("word", "проверками управления осуществляется экологических план формированию делать".split())
def test_stem_on_driver_and_in_columns(spark, word):
    assert one(spark, T.stem, word) == T.stem_of(word)


def test_normal_forms(spark):
    assert one(spark, T.normalize_text, "  3.1. Ведёт  учёт; (сводный) ") == "ведет учет сводный"
    assert one(spark, T.norm_lead, "5.3. Директор 7:") == "директор"
    assert one(spark, T.fold, "Straße  Ёж ") == "strasse еж"
    assert one(spark, T.quote_key, " «Ведёт» учёт. ") == "ведет учет"
    assert one(spark, T.normalize_text, None) == ""


def test_numbers(spark):
    assert one(spark, T.number_parent, "3.2.1") == "3.2" and one(spark, T.number_parent, "3") is None
    assert one(spark, T.number_ancestors, "3.2.1.а") == ["3", "3.2", "3.2.1"] and one(spark, T.number_ancestors, "3") == []
    assert sorted(one(spark, T.number_successors, "3.9")) == ["3.10", "3.9.1", "4"]
    assert one(spark, T.number_key, " 4.2.A. ") == "4.2.а"


def test_unit_names(spark):
    assert one(spark, T.unit_name_key, "Департамента «контроля» (ДК) Общества") == "департамент контроля"
    assert one(spark, T.abbreviation, "Департамент надзора (далее – ДНМ)") == "ДНМ" and one(spark, T.abbreviation, "БВА") == "БВА" and one(spark, T.abbreviation, "Отдел") is None
    assert units.unit_phrases("Согласует с департаментом внутреннего аудита (ДВА) и отделом закупок обязан") == [("департамент внутреннего аудита", "ДВА"), ("отдел закупок", None)]
    assert units.unit_phrases("управление рисками") == [] and units.unit_phrases(None) == []


def test_templates(spark):
    assert one(spark, T.is_template_for_retrieval, "Выполняет иные функции в пределах своей компетенции")
    assert not one(spark, T.is_template_for_retrieval, "Готовит сводный отчёт о закупках")
    assert one(spark, T.is_template_for_duplicates, "Выполнение прочих поручений руководства")
    assert not one(spark, T.is_template_for_duplicates, "Готовит сводный отчёт о закупках предприятия")


def test_signature(spark):
    assert one(spark, T.verb_class, "Обеспечивает разработку регламентов") == "СОЗДАВАТЬ"
    assert one(spark, T.verb_class, "что-то иное") == "ПРОЧЕЕ"
    assert one(spark, T.usable_signature, "A|") is None and one(spark, T.usable_signature, "A| b") == "A| b" and one(spark, T.usable_signature, None) is None


def test_small_ones(spark):
    assert one(spark, T.safe_filename, "dir/a b?.docx") == "a_b_.docx"
    assert one(spark, T.redact_secrets, "key sk-abcdefgh12345 end") == "key *** end"
    assert one(spark, T.document_prefix, "abc:p1:0") == "abc"


def test_quotes_and_references():
    assert quoted("ведёт учёт", "Отдел ВЕДЁТ учёт дел") and quoted("отдел ... дел.", "Отдел ведёт учёт дел")
    assert quoted('"отдел"', "«Отдел» ведёт") and not quoted("дел ... отдел", "Отдел ведёт учёт дел") and not quoted("...", "текст")
    text, gone = report.scrub_references("См. п. 9.1 и 5.1.2, порог 0.85 (см. 5.1.2).", {"9.1", "9.2"})
    assert gone == ["5.1.2", "5.1.2"] and "9.1" in text and "0.85" in text and "5.1.2" not in text and "()" not in text


def test_payload_key_ignores_order():
    assert report.payload_key({"а": 1, "b": None}) == report.payload_key({"b": None, "а": 1}) != report.payload_key({"а": 2, "b": None})


def test_common_ancestor(spark):
    tree = spark.createDataFrame([("r", ["r"]), ("a", ["r", "a"]), ("b", ["r", "a", "b"]), ("c", ["r", "a", "c"]), ("o", ["o"])], "unit_id string, path array<string>")
    pairs = spark.createDataFrame([("b", "c"), ("b", "a"), ("b", "o"), ("b", "zz")], "x string, y string")
    assert {(x.x, x.y): x.ancestor_id for x in units.common_ancestor(pairs, tree, "x", "y").collect()} == {("b", "c"): "a", ("b", "a"): "a", ("b", "o"): None, ("b", "zz"): None}
