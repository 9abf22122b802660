"""Near-duplicates, groups of matches, variant spellings: brute force on small inputs, and odd inputs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clauseflow.llm import components, minhash, names

WORDS = "готовит сверку отчёт план проект контур карту этап реестр баланс акт приказ опрос лимит смету архив тариф замер".split()


def _norm(t):
    return re.sub(r"[\W_]+", " ", t.lower().replace("ё", "е")).strip()


def _grams(t):
    t = t if len(t) >= 4 else t.ljust(4, "\0")
    return {t[i : i + 4] for i in range(len(t) - 3)}


def _brute(rows, limit=0.6):
    out = set()
    rows = sorted({(i, _norm(t)) for i, t in rows if i is not None and t is not None and _norm(t)})
    for x, (i, s) in enumerate(rows):
        for j, t in rows[x + 1 :]:
            if i != j:
                a, b = _grams(s), _grams(t)
                if len(a & b) / len(a | b) >= limit:
                    out.add((min(i, j), max(i, j)))
    return out


def _texts(n, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        t = " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(18))
        rows.append((f"f{k:04d}", t))
        if k % 3 == 0:
            w = t.split()
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = r.choice(WORDS) + "х"
            rows.append((f"g{k:04d}", " ".join(w).upper()))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = _texts(120)
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in minhash.near_duplicate_pairs(df).collect()}
    near = {p for p in _brute(rows, 0.57) - _brute(rows, 0.63)}  # pairs at the limit may fall to either side of sampling
    assert got - near == _brute(rows) - near
    assert got <= _brute(rows)


def test_pairs_odd_rows(spark):
    long = " ".join(f"слово{k}" for k in range(20000)) + " "
    rows = [("a", "Один текст, ёлка"), ("b", "один  текст елка"), ("b", "один  текст елка"), ("c", None), (None, "один текст елка"), ("d", ""), ("e", " …— "), ("f", "аб"), ("g", "аб!"), ("h", long), ("i", long + "конец")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, text string, key int, t int")
    assert {tuple(r) for r in minhash.near_duplicate_pairs(df).collect()} == {("a", "b"), ("f", "g"), ("h", "i")}
    assert minhash.near_duplicate_pairs(df.limit(0)).count() == 0


def test_many_equal_texts_are_one_record(spark):
    df = spark.createDataFrame([(f"x{k:03d}", "Один и тот же текст функции") for k in range(60)], "id string, text string")
    assert minhash.near_duplicate_pairs(df).count() == 60 * 59 // 2
    keyed = minhash.keyed(df, "id", "text").select("key", "t")
    assert minhash.candidate_pairs(keyed).count() == 0


def test_near_groups(spark):
    rows = _texts(40)
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r[0]: r[1] for r in minhash.near_duplicate_groups(df).select("function_id", "group_id").collect()}
    assert set(got) == {i for i, _ in rows}
    for a, b in _brute(rows, 0.63):
        assert got[a] == got[b]
    for i, g in got.items():
        assert g <= i


def test_signature_estimates_similarity():
    plan = minhash.Plan()
    a, b = "абвгдежз" * 12, "абвгдежз" * 9 + "иклмнопр" * 3
    r = random.Random(3)
    for _ in range(5):
        t = "".join(r.choice("абвгдежзик") for _ in range(300))
        u = t[:200] + "".join(r.choice("лмнопрстуф") for _ in range(60))
        s = minhash.signatures([t, u, a, b], plan)
        true = len(_grams(t) & _grams(u)) / len(_grams(t) | _grams(u))
        assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_jaccard_is_exact():
    r = random.Random(5)
    left = ["".join(r.choice("абв 1x") for _ in range(r.randrange(0, 40))) for _ in range(200)]
    right = ["".join(r.choice("абв 1x") for _ in range(r.randrange(0, 40))) for _ in range(200)]
    got = minhash.jaccard(left, right, 4)
    want = [len(_grams(x) & _grams(y)) / len(_grams(x) | _grams(y)) for x, y in zip(left, right)]
    assert np.allclose(got, want)


def test_blocks_come_back_whole():
    r = np.random.default_rng(3)
    for n in (0, 1, 500):
        key = np.empty(n, minhash._KEY)
        key["k1"], key["k2"] = r.integers(-(2**62), 2**62, n), r.integers(-(2**31), 2**31 - 1, n)
        sketch, count = r.integers(0, 2**63, (n, 4)).astype(np.uint64), r.integers(0, 90, n)
        hashes = r.integers(0, 2**63, int(count.sum())).astype(np.uint64)
        k, s, h, row = minhash._unpack(minhash._block(key, sketch, count, hashes), 4)
        assert np.array_equal(k, key) and np.array_equal(s, sketch) and np.array_equal(row, np.repeat(np.arange(n), count))
        assert np.array_equal(h, hashes & np.uint64((1 << minhash.HASH_BITS) - 1))


# ---- groups of matches


def _union_find(rows):
    f = {}

    def find(x):
        while f.setdefault(x, x) != x:
            x = f[x]
        return x

    for b, a in rows:
        ids = [x for x in [b, *(a or [])] if x is not None]
        for x in ids:
            p, q = find(ids[0]), find(x)
            if p != q:
                f[max(p, q)] = min(p, q)
    return {x: find(x) for x in f}


@pytest.mark.parametrize("max_hops", [1, 8])
def test_groups_equal_union_find(spark, max_hops):
    r = random.Random(2)
    rows = [(f"h{k}", ["hub"]) for k in range(60)] + [(f"c{k:03d}", [f"c{k + 1:03d}"]) for k in range(70)]
    rows += [("h3", ["c010"])] if max_hops == 1 else []
    rows += [(f"r{r.randrange(40)}", [f"r{r.randrange(40)}", None, f"r{r.randrange(40)}"]) for _ in range(20)]
    rows += [(None, ["n1", "n2"]), ("alone", None), ("alone2", []), (None, None), (None, [None]), ("s", ["s"]), ("s", ["s"]), ("", ["blank"])]
    df = spark.createDataFrame([(*x, "u", "v") for x in rows], "before_id string, after_ids array<string>, u string, label string")
    got = components.link_groups(df, max_hops=max_hops).collect()
    assert len(got) == len({x[0] for x in got})
    assert {x[0]: x[1] for x in got} == _union_find(rows)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "before_id string, after_ids array<string>")
    assert components.link_groups(df).count() == 0
    df = spark.createDataFrame([("a", None), ("b", []), (None, None)], "before_id string, after_ids array<string>")
    assert {tuple(r) for r in components.link_groups(df).collect()} == {("a", "a"), ("b", "b")}


# ---- names


def _lev(a, b):
    """Distance with swaps of neighbours (each letter edited once)."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_finds_what_a_table_finds():
    r = random.Random(4)
    words = {"".join(r.choice("абв") for _ in range(r.randrange(1, 8))) for _ in range(150)}
    trie = names.Trie(words)
    for _ in range(80):
        p = "".join(r.choice("абв") for _ in range(r.randrange(1, 8)))
        for k in (0, 1, 2):
            assert dict(trie.near(p, k)) == {w: _lev(p, w) for w in words if _lev(p, w) <= k}


REGISTRY = [
    (1, "unit", "Отдел складских активов и исков"), (2, "unit", "Отдел складских активов и ревизий"), (3, "unit", "Дирекция учётных поставок и замеров"),
    (10, "person", "Велозуган Фёдор Романович"), (11, "person", "Барадебина Инна Юрьевна"),
]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Отдела складских активов и исков", 1), ("ОТДЕЛ СКЛАДСКИХ АКТИВОВ И ИСКОВ", 1), ("Складских активов и исков, отдел", 1), ("Отдел исков и складских активов", 1),
        ("Отд. склад. акти. и исков", 1), ("отд-л складских активов, исков", 1), ("«Отдел складских активов и ревизий» ООО «Ромашка»", 2), ("Отдел складкисх активов и исков", 1),
        ("О.С.А.И.", 1), ("ОСАР", 2), ("Отдел САИ", 1), ("Отдел складских активов", None), ("Отдел складских исков и ревизий", None), ("Отдел учётных активов и исков", None),
        ("Ф.Р. Велозуган", 10), ("Велозуган Ф Р", 10), ("ВЕЛОЗУГАН Ф.Р.", 10), ("Федя Велозуган", 10), ("Велозуган (Федя)", 10), ("г-н Велозуган", 10), ("Велозугана Фёдора Романовича", 10),
        ("диспетчер Велозуган Ф.Р.", 10), ("F. Velozugan", 10), ("Велозуаган Фёдор", 10), ("Барадебиной И.Ю.", 11), ("Велозуган П.", None), ("Велозуган Пётр Романович", None), ("старший диспетчер", None), ("", None), ("!!!", None),
    ],
)
def test_spellings(text, want):
    hit = names.Names(REGISTRY).match(text)
    assert (hit[0] if hit else None) == want


def test_link_names_odd_rows(spark):
    registry = spark.createDataFrame([*REGISTRY, (None, "unit", "x"), (12, "unit", None)], "entity_id long, kind string, name string")
    rows = [("unit", "u1", "отдел складских активов и исков"), ("unit", "u1", "отдел складских активов и исков"), ("unit", "u2", "Отдел складских активов и исков"), ("unit", "u3", None), ("function", None, "г-н Велозуган"), ("function", "f1", "г-н Велозуган"), ("function", "f2", "ж" * 50000)]
    df = spark.createDataFrame([(*r, 7, "n") for r in rows], "origin string, record_id string, spelling string, entity_id int, name string")
    want = {("unit", "u1", 1), ("function", "f1", 10)}
    got = names.link_names(df, registry).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert names.link_names(df, registry.limit(0)).count() == 0
    assert names.link_names(df.limit(0), registry).count() == 0


def test_two_equal_explanations_stay_unlinked():
    n = names.Names([(1, "person", "Велозуган Фёдор Романович"), (2, "person", "Велозуган Филипп Романович")])
    assert n.match("Велозуган Ф.Р.") is None
    assert n.match("Велозуган Фёдор")[0] == 1


def test_short_surnames():
    n = names.Names([(1, "person", "Ким Олег Петрович"), (2, "person", "Цой Анна Ивановна"), (3, "person", "Ли Вера Олеговна"), (4, "person", "Ю Пётр Ильич"), (5, "person", "Рогов Семён Ильич")])
    for text, want in [("Ким О.П.", 1), ("КИМ ОЛЕГ ПЕТРОВИЧ", 1), ("Цой А.И.", 2), ("Ли В.О.", 3), ("Ю Пётр Ильич", 4), ("Кин Олег Петрович", 1), ("Рокоф Семён Ильич", 5)]:
        assert (n.match(text) or [None])[0] == want, text
    assert n.match("Рокоф С.И.") is None and n.match("Пак О.П.") is None


def test_shards_change_nothing(spark):
    r = random.Random(3)
    units = [(k, "unit", f"{r.choice(('Отдел', 'Служба', 'Управление'))} {a} {b}") for k, (a, b) in enumerate((a, b) for a in ("учёта", "проверки", "закупок", "ремонта") for b in ("складов", "договоров", "запасов"))]
    people = [(100 + k, "person", f"{s} {f} {o}") for k, (s, f, o) in enumerate((s, f, o) for s in ("Ли", "Велозуган", "Велозугин", "Каримов") for f in ("Фёдор", "Филипп") for o in ("Романович", "Ильич"))]
    rows = units + people
    spellings = [n for _, _, n in rows] + ["Велозуган Ф.Р.", "Велозугин Фёдор Р.", "Ли Ф.И.", "Ли Филипп Ильич", "отд. учета складов", "Служба учёта складв", "ОУС", "Каримв Федя Ильич", "Велозуган Ф.", "учёта складов отдел", "Никто", None]
    registry = spark.createDataFrame(rows, "entity_id long, kind string, name string")
    df = spark.createDataFrame([(s,) for s in spellings], "spelling string")
    one = {tuple(x) for x in names.match_spellings(df, registry).collect()}
    n = names.Names(rows)
    official = {i: name for i, _, name in rows}
    assert one == {(s, n.match(s)[0], official[n.match(s)[0]]) for s in spellings if s and n.match(s)}
    for size, task in ((1, 1000), (3, 4), (7, 2)):
        assert one == {tuple(x) for x in names.match_spellings(df, registry, size, task).collect()}


def test_trie_beginnings():
    words = ["отдел", "отделение", "департамент", "деление"]
    t = names.Trie(words)
    assert sorted(t.starting("отдел")) == ["отдел", "отделение"] and t.starting("я") == [] and len(t.starting("")) == 4
    assert t.begun("отдл", 1) == ["отдел", "отделение"]


def test_bands_that_many_texts_share(spark):
    """Texts of one boilerplate meet block by block; the pairs are those of the ordinary way."""
    r = random.Random(8)
    base = " ".join(r.choice(WORDS) for _ in range(40))
    rows = [(f"{k:03d}", f"{base} {' '.join(r.choice(WORDS) for _ in range(r.randrange(0, 25)))} {k}") for k in range(150)] + [(f"x{k}", " ".join(r.choice(WORDS) for _ in range(12))) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(5)
    plain = {tuple(x) for x in minhash.near_duplicate_pairs(df).collect()}
    assert plain == {tuple(x) for x in minhash.near_duplicate_pairs(df, heavy=20, sample=100).collect()}
    want = _brute(rows)
    assert len(plain & want) >= 0.99 * len(want) and plain <= want
    texts = minhash.keyed(df, "id", "text").select("key", "t")
    assert len(minhash._heavy_values(texts, minhash.Plan(), 210, 20, 100)) > 10


def test_long_texts_do_not_fill_all_slots():
    r = np.random.default_rng(4)
    a, b = ("".join(chr(97 + c) for c in r.integers(0, 26, 300_000)) for _ in range(2))
    c = a[:240_000] + b[:30_000]
    text, long, sig = minhash._all_signatures([a, b, c, "коротко"], minhash.Plan())
    assert text.tolist() == [3, 0, 1, 2] and long.tolist() == [False, True, True, True]
    same = lambda x, y: float((sig[x] == sig[y]).mean())
    grams = [{t[i : i + 4] for i in range(len(t) - 3)} for t in (a, b, c)]
    for x, y in ((1, 2), (1, 3)):
        assert abs(same(x, y) - len(grams[x - 1] & grams[y - 1]) / len(grams[x - 1] | grams[y - 1])) < 0.12
    middle = "".join(chr(97 + k) for k in r.integers(0, 26, 6_500))
    assert minhash._all_signatures([middle], minhash.Plan())[1].tolist() == [False, True]


def test_rounds_of_bands_find_the_same_pairs_with_bounded_buckets(spark, monkeypatch):
    r = random.Random(8)
    words = [f"слово{k}" for k in range(300)]
    texts = [" ".join(r.choices(words, k=12)) for _ in range(60)]
    texts += [t.rsplit(" ", k)[0] for t in texts for k in (1, 2)] + ["одно и то же начало каждого положения " + " ".join(r.choices(words, k=3)) for _ in range(90)] + texts[:5]
    df = spark.createDataFrame([(f"f{k:03d}", t) for k, t in enumerate(texts)], "id string, text string")
    key = minhash.keyed(df, "id", "text").select("key", "t")
    found = lambda **how: {tuple(x) for x in minhash.similar_texts(key, rows=len(texts), **how).collect()}
    at_once, heavy_at_once = found(), found(heavy=20, sample=100)
    monkeypatch.setattr(minhash, "ROUND_TEXTS", 100)
    monkeypatch.setattr(minhash, "BUCKET_TEXTS", 150)
    monkeypatch.setattr(minhash, "HEAVY_BLOCK", 16)
    assert len(at_once) > 100
    assert found() == at_once == heavy_at_once == found(heavy=20, sample=100)

    # a text takes a bounded number of bytes in a round, however many buckets there are
    plan, n = minhash.Plan(), len(set(texts))
    rows = pa.RecordBatch.from_pydict({"k1": pa.array(range(n), pa.int64()), "k2": pa.array([0] * n, pa.int32()), "t": sorted(set(texts))})
    signed = pa.Table.from_batches(minhash._sign(plan, np.empty(0, np.uint64))([rows])).combine_chunks().to_batches()[0]
    one = pa.RecordBatch.from_arrays([signed.column(c) for c in ("k1", "k2", "s", "h0")], names=["k1", "k2", "s", "h"])
    moved = sum(len(b.as_py()) for x in minhash._pack_round(plan, np.arange(5000))([one]) for b in x.column("block"))
    assert moved <= n * minhash.ROUND_BANDS * (8 + 12 + 32 + 2 + 3)
