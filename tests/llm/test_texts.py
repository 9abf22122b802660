"""One form of text, packing, leaks, personal data."""

import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseflow.llm import leakage, packing, pii, textform

ODD = "абвёйАВСЕ abcEHP 012 ０１２ＡＢ̆̈​‍­﻿⁠   ‐‑-ΑΒοé가ﬁ①²"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD, max_size=40))
def test_segments_equal_the_whole(text):
    assert textform.canonical_text(text) == textform.canonical_whole(text)
    once = textform.canonical_text(text)
    assert textform.canonical_text(once) == once


def test_stable_characters_are_stable():
    import re

    for ch in map(chr, range(0x3100)):
        if not re.match(textform.UNSTABLE, ch):
            assert textform.canonical_whole(ch) == ch and not unicodedata.combining(ch)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("стр. 12", "стр. １２", True), ("й", "й", True), ("сорт", "copт", True), ("а-б", "а‑б", True), ("а б", "а б", True), ("слово", "сло­во​", True), ("ёлка", "елка", False), ("Акт", "акт", False), ("12", "13", False), ("м2", "м²", False), ("а–б", "а-б", False)],
)
def test_what_looks_the_same(a, b, same):
    assert (textform.canonical_text(a) == textform.canonical_text(b)) is same


def test_lookalike_quotes_odd_rows(spark):
    clauses = spark.createDataFrame([("c1", "Готовит отчёт 12", 1), ("c1", "Готовит отчёт 12", 1), ("c2", None, 1), (None, "x", 1), ("c3", "я" * 200000 + "ко̆т", 1)], "id string, text string, quote int")
    rows = [(1, "c1", "отчёт １２"), (1, "c1", "отчёт １２"), (2, "c1", "отчёт 12"), (3, "c1", "отчёт 13"), (4, "c1", None), (5, None, "x"), (6, "c9", "x"), (7, "c2", "x"), (8, "c1", ""), (9, "c1", "​"), (10, "c3", "я­ко̆т")]
    citations = spark.createDataFrame(rows, "citation_id long, clause_id string, quote string")
    got = sorted(r[0] for r in textform.lookalike_quotes(citations, clauses).collect())
    assert got == [1, 9, 10]
    assert textform.lookalike_quotes(citations.limit(0), clauses).count() == 0
    assert textform.lookalike_quotes(citations, clauses.limit(0)).count() == 0


def test_canonicalize_keeps_rows(spark):
    df = spark.createDataFrame([(1, "а­б", "z"), (2, None, "z"), (3, "", "z"), (3, "", "z")], "id int, text string, changed string")
    assert sorted((r["id"], r["canonical"]) for r in textform.canonicalize(df, "text").collect() if r["canonical"] is not None) == [(1, "аб"), (3, ""), (3, "")]
    assert textform.canonicalize(df, "text").count() == 4


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 70))
def test_fill_is_a_packing(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    pack = packing.fill(sizes, capacity)
    assert len(pack) == len(sizes)
    if len(sizes):
        assert np.bincount(pack, weights=sizes).max() <= capacity


def test_fill_leaves_little_room():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 900, 4000)
    pack = packing.fill(sizes, 1000)
    assert pack.max() + 1 <= -(-sizes.sum() // 1000) * 1.01
    assert packing.fill(np.array([6, 5, 5, 4]), 10).tolist() in ([0, 1, 1, 0], [1, 0, 0, 1])


def test_pack_texts_whole_and_split(spark):
    r = random.Random(1)
    docs = [(k, " ".join(r.choice(("отчёт", "plan", "сверка", "42")) for _ in range(r.randrange(0, 120))), "x") for k in range(80)]
    docs += [(100, "слово " * 3000, "x"), (101, None, "x"), (None, "нет", "x"), (102, "", "x"), (5, docs[5][1], "y")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, pack_id string")
    kinds = spark.createDataFrame([("s", 128), ("m", 512), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens long")
    out = packing.pack_texts(documents, kinds, shard_items=30).toPandas()
    enc = packing.encoder()
    want = {i: len(enc.encode_ordinary(t)) for i, t, _ in docs if i is not None and t is not None}
    for kind, capacity in (("s", 128), ("m", 512)):
        mine = out[out.container_kind == kind]
        assert mine.groupby("doc_id").n_tokens.sum().to_dict() == want
        assert mine.groupby("pack_id").n_tokens.sum().max() <= capacity
        for i, rows in mine.groupby("doc_id"):
            rows = rows.sort_values("piece")
            assert len(rows) == max(1, -(-want[i] // capacity))  # only what is larger than the capacity is cut
            assert rows.first_token.tolist() == [capacity * p for p in range(len(rows))]
    assert set(out.container_kind) == {"s", "m"}
    assert packing.pack_texts(documents.limit(0), kinds).count() == 0
    assert packing.pack_texts(documents, kinds.limit(0)).count() == 0


# ---- leaks


def _brute_leaks(docs, items, run=13):
    runs = {}
    for i, t in items:
        w = leakage.words(t)
        for a in range(len(w) - run + 1):
            runs.setdefault(tuple(w[a : a + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for a in range(len(w) - run + 1):
            out |= {(d, i) for i in runs.get(tuple(w[a : a + run]), ())}
    return out


def test_leaks_equal_brute_force():
    r = random.Random(7)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(5, 60)))) for k in range(40)] + [(90, "a " * 20), (91, "A, a; " * 10)]
    docs = []
    for d in range(300):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 90))]
        if d % 3 == 0:
            src = leakage.words(r.choice(items)[1])
            a = r.randrange(0, max(1, len(src) - 8))
            w[len(w) // 2 : len(w) // 2] = src[a : a + r.choice((12, 13, 14, 30))]
        docs.append((d, "  ".join(x.upper() if r.random() < 0.3 else x for x in w).replace("  ", r.choice((" ", ", ", "\n- ")))))
    docs.append((999, "a " * 13))
    index = leakage.Index([(i, leakage.words(t)) for i, t in items])
    got = {(docs[d][0], int(index.ids[j])) for d, j, *_ in index.search([t for _, t in docs])}
    assert got == _brute_leaks(docs, items)
    assert len(got) > 20


def test_scores_equal_brute_force_bm25():
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, [r.choice(vocab) for _ in range(r.randrange(13, 60))]) for k in range(200)]
    index = leakage.Index(items)
    n, mean = len(items), sum(len(w) for _, w in items) / len(items)
    df = Counter(x for _, w in items for x in set(w))
    codes = np.array([r.randrange(len(index.vocab) + 1) for _ in range(5000)] + index.seqs[3].tolist(), np.int32)
    starts = np.arange(0, len(codes) - 25, 13)
    got = {(int(p), int(j)): s for p, j, s in zip(*index.passages(codes, starts, starts + 25))}
    names = [*index.vocab, "?"]
    want = {}
    for p, a in enumerate(starts):
        passage = {names[c] for c in codes[a : a + 25]}
        for j, (_, w) in enumerate(items):
            tf = Counter(w)
            s = sum(np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.5 / (tf[x] + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in passage & set(w))
            if s >= index.least[j]:
                want[p, j] = s
    assert got.keys() == want.keys() and len(got) > 0
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_split_index_gives_the_same(spark):
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(30)), r.choice((None, "w1 w2", "w3"))) for k in range(40)] + [(7, " ".join(r.choice(vocab) for _ in range(20)), None)]
    docs = [(d, " ".join(r.choice(vocab) for _ in range(20)) + " " + r.choice(items)[1] + " w3") for d in range(60)]
    i, d = spark.createDataFrame(items, "item_id long, text string, answer string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda df: sorted((*x[:3], round(x[3], 9), *x[4:]) for x in df.collect())
    one = rows(leakage.leaks(d, i))
    assert one == rows(leakage.leaks(d, i, index_postings=100))
    assert {(a, b) for a, b, *_ in one} == _brute_leaks(docs, [(a, b) for a, b, _ in items])
    assert {x[5] for x in one} == {True, False}


def test_leaks_odd_rows(spark):
    text = " ".join(f"слово{k}" for k in range(20))
    items = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, "коротко", 0), (3, None, 0), (None, text, 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(1, "начало\n" + text.upper() + "!", 0), (1, "начало\n" + text.upper() + "!", 0), (2, " ".join(text.split()[:12]), 0), (3, None, 0), (None, text, 0), (4, "", 0), (5, "x " * 300000 + text, 0)], "doc_id long, text string, item_id int")
    assert sorted((r.doc_id, r.item_id, r.run_words) for r in leakage.leaks(docs, items).collect()) == [(1, 1, 20), (5, 1, 20)]
    assert leakage.leaks(docs, items.limit(0)).count() == 0
    assert leakage.leaks(docs.limit(0), items).count() == 0


# ---- personal data


def _gold(pieces):
    text, spans = "", set()
    for t, kind in pieces:
        if kind:
            spans.add((len(text), len(text) + len(t), kind))
        text += t
    return text, spans


def test_field_on_held_out_sentences():
    model = pii.field()
    hit = found = want = 0
    for pieces in pii.labelled(300, seed=77):
        text, gold = _gold(pieces)
        got = set(pii.find([text], model)[0])
        hit, found, want = hit + len(got & gold), found + len(got), want + len(gold)
    assert hit / found > 0.97 and hit / want > 0.96


def _marked_lines(name):
    for line in (Path(__file__).with_name(name)).read_text(encoding="utf-8").splitlines():
        if line and not line.startswith("#"):
            parts = re.split(r"(\[\[\w+:.*?\]\](?!\]))", line)
            marks = [re.fullmatch(r"\[\[(\w+):(.*)\]\]", p) for p in parts]
            yield _gold([(m[2], m[1]) if m else (p, "") for p, m in zip(parts, marks)])


@pytest.mark.parametrize("name", ["pii_development.txt", "pii_development2.txt", "pii_heldout.txt"])
def test_field_on_lines_written_by_hand(name):
    model = pii.field()
    hit, found, want = Counter(), Counter(), Counter()
    for text, gold in _marked_lines(name):
        got = set(pii.find([text], model)[0])
        for c, spans in ((hit, got & gold), (found, got), (want, gold)):
            c.update(k for _, _, k in spans)
    assert sum(hit.values()) / sum(found.values()) >= 0.9 and sum(hit.values()) / sum(want.values()) >= 0.9
    assert all(hit[k] / want[k] >= 0.85 and hit[k] / found[k] >= 0.8 for k in pii.KINDS)


def test_stored_weights_are_whole():
    model = pii.field()
    again = pii.unpack_field(pii.pack_field(model))
    assert again.known == model.known and np.array_equal(again.weights, model.weights) and np.array_equal(again.trans, model.trans)


def test_viterbi_in_batches_equals_one_by_one():
    model = pii.field()
    texts = ["".join(t for t, _ in p) for p in pii.labelled(60, seed=5)]
    assert pii.find(texts, model) == [pii.find([t], model)[0] for t in texts]


def test_islands_change_nothing():
    """Cutting texts at certain tokens gives the labels of the uncut text."""
    model = pii.field()
    full = pii.Field(model.known, model.weights, model.trans, model.start)
    full.gain = np.full_like(model.gain, 1e6)
    for p in pii.labelled(80, seed=6):
        toks = pii.tokens("".join(t for t, _ in p))
        assert model.label([toks]).tolist() == full.label([toks]).tolist()


def test_personal_data_odd_rows(spark):
    t = "Контактное лицо: И.П. Сидоркин, тел. +7 203 217 14 69, e-mail sidor@primer.example. Договор № 21-118/4 учтён в описи 740."
    rows = [(1, t + " " + t), (1, t), (2, None), (None, t), (3, ""), (4, "слово " * 100000 + t), (5, "\n\n")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kind string")
    got = {tuple(r) for r in pii.personal_data(docs).collect()}
    for d in (1, 4):
        assert {(d, "phone", "+7 203 217 14 69"), (d, "email", "sidor@primer.example"), (d, "person", "И.П. Сидоркин")} == {x for x in got if x[0] == d}
    assert {x[0] for x in got} == {1, 4}
    out = {(r[0], r[1]) for r in pii.masked(docs).collect()}
    assert (1, "Контактное лицо: [PERSON], тел. [PHONE], e-mail [EMAIL]. Договор № 21-118/4 учтён в описи 740.") in out
    assert (2, None) in out and (3, "") in out and (5, "\n\n") in out
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.masked(docs.limit(0)).count() == 0
