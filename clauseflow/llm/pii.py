"""Personal data in free text: a linear-chain conditional random field over word shapes.

Texts are cut into words, numbers, signs and line ends. What the field sees of a token (shape, ends, short
or common words, the same of its neighbours) depends on the token's string only, so it is worked out once for each
distinct string; scores of a batch of texts are then sums of gathered rows, and Viterbi runs in numpy over many
sequences at a time. Tokens that can't be anything but outside, whatever their neighbours are
labelled, cut a text into short sequences first; the bound on what transitions can add makes that exact.

The field is trained apart from the queries (`python -m clauseflow.llm.pii`), from the labelled table that `pii_table`
writes by rule; queries load the stored weights. The table's seed and size are fixed, so training again gives the same weights.
"""

from __future__ import annotations

import io
import re
from functools import lru_cache
from importlib import resources
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.llm.pii_table import labelled
from clauseflow.llm.textform import canonical_text

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
REACH = 3  # neighbours on each side that a token's score looks at

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\S\r\n]*[\r\n]\s*|[^\w\s]|_")

# ---------------------------------------------------------------- tokens and what the field sees of them


def tokens(text: str) -> list[str]:
    """Words, numbers, signs and line ends; other blanks fall out."""
    return _TOKEN.findall(text)


def places(text: str, upto: int) -> list[tuple[int, int]]:
    """Where the first `upto` tokens begin and end."""
    return [m.span() for m in islice(_TOKEN.finditer(text), upto)]


def features(token: str) -> list[str]:
    """What the field sees of one token; width, look-alikes and invisible characters are looked through."""
    t = canonical_text(token) if not token.isascii() else token
    low = t.lower()
    if not t or t.isspace():
        return ["line end"]
    if t.isdigit():
        return ["digits", f"digits{min(len(t), 21)}", f"w={t}" if len(t) == 1 or t in ("001",) else f"d0={t[0]}"]
    if not t[:1].isalpha():
        return [f"w={low}", "sign"]
    case = "X" if t.isupper() else "Xx" if t[0].isupper() else "x"
    script = "cyr" if re.match("[а-яё]", low) else "lat"
    size = "1" if len(t) == 1 else "2" if len(t) <= 3 else "4"
    return [f"w={low}", f"case={case}{size}", f"script={script}", f"{case}{script}", f"{case}-{low[-2:]}", f"{case}-{low[-3:]}"]


class Field:
    """A linear-chain conditional random field. w: (offsets, features, labels), transitions and starts."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.known, self.weights, self.trans, self.start = known, weights, trans, start
        # What a label other than O could gain over O at one token through its transitions. Where O takes its place and the next
        # token is inside, that one becomes a beginning: the change of its own score is added for each token.
        k = len(LABELS)
        begun = np.array([b - 1 if lb[0] == "I" else b for b, lb in enumerate(LABELS)])
        ahead = max(0.0, max(float((trans[b] - trans[b - 1]).max()) for b in range(2, k, 2)))
        before = np.maximum((trans - trans[:, :1]).max(0), start - start[0])
        after = np.maximum((trans - trans[0][begun]).max(1), 0)  # at the end of a text nothing follows
        self.gain = (before + after + ahead)[1:].astype(np.float32)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((2 * REACH + 1, 1024, len(LABELS)), np.float32)  # row 0: beyond the text
        self.blank = np.zeros(1024, bool)
        self.count = 1

    def __getstate__(self):
        return (self.known, self.weights, self.trans, self.start)

    def __setstate__(self, state):
        self.__init__(*state)

    def _row(self, token: str) -> int:
        if self.count == self.table.shape[1]:
            if self.count >= 1 << 18:  # strings seen only once would fill the memory: begin again
                raise OverflowError
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.blank = np.concatenate([self.blank, np.zeros_like(self.blank)])
        ids = [self.known[f] for f in features(token) if f in self.known]
        self.table[:, self.count] = self.weights[:, ids].sum(1)
        self.blank[self.count] = token.isspace()
        self.rows[token] = self.count
        self.count += 1
        return self.count - 1

    def codes(self, toks: list[str]) -> np.ndarray:
        get = self.rows.get
        try:
            return np.fromiter((get(t) or self._row(t) for t in toks), np.int64, len(toks))
        except OverflowError:
            self.rows, self.count = {}, 1
            room = max(1024, len(set(toks)) + 2)
            self.table = np.zeros((2 * REACH + 1, room, len(LABELS)), np.float32)
            self.blank = np.zeros(room, bool)
            return self.codes(toks)

    def label(self, texts_tokens: list[list[str]]) -> np.ndarray:
        """Labels of all tokens of all texts, one after another."""
        lens = np.fromiter(map(len, texts_tokens), np.int64, len(texts_tokens))
        pad = REACH
        flat: list[str] = [t for toks in texts_tokens for t in toks]
        code = self.codes(flat)
        # texts are set apart by REACH rows of nothing, so that neighbours never come from another text
        shift = np.repeat(np.arange(1, len(lens) + 1) * pad, lens)
        wide = np.zeros(len(code) + pad * (len(lens) + 1), np.int64)
        place = np.arange(len(code)) + shift
        wide[place] = code
        score = self.table[REACH][code]
        for o in range(-REACH, REACH + 1):
            if o:
                score += self.table[o + REACH][wide[place + o]]
        out = np.zeros(len(code), np.int64)
        # a token whose best other label can't make up its distance to O with any transitions is outside
        more = np.maximum(score[:, 2::2] - score[:, 1::2], 0)  # of each kind
        more = np.repeat(np.concatenate([more[1:], np.zeros_like(more[:1])]), 2, axis=1)
        open_ = (score[:, 1:] + self.gain + more).max(1) > score[:, 0]
        first = np.zeros(len(code), bool)
        first[np.cumsum(lens)[:-1][np.cumsum(lens)[:-1] < len(code)]] = True
        if len(code):
            first[0] = True
        open_ &= ~self.blank[code]  # a line end is always outside
        live = np.flatnonzero(open_)
        if not len(live):
            return out
        breaks = np.r_[True, (np.diff(live) > 1) | first[live[1:]]]
        starts = np.flatnonzero(breaks)
        runs = np.diff(np.r_[starts, len(live)])
        order = np.argsort(-runs, kind="stable")
        at, runs = live[starts][order], runs[order]
        follows = at + runs
        ends = (follows >= len(code)) | first[np.minimum(follows, len(code) - 1)]
        a = 0
        while a < len(at):  # sequences of like length together, longest first
            b = a + max(1, min(8192, 400_000 // int(runs[a])))
            self._viterbi(score, at[a:b], runs[a:b], first[at[a:b]], ends[a:b], out)
            a = b
        return out

    def _viterbi(self, score: np.ndarray, at: np.ndarray, size: np.ndarray, fresh: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
        """Writes the best labels of the sequences that begin at `at` and are `size` long (descending) to `out`.

        fresh: begins a text; last: ends one, else an outside token follows.
        """
        k, n, longest = len(LABELS), len(at), int(size[0])
        going = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences with a token t
        best = score[at].T + np.where(fresh, self.start[:, None], self.trans[0][:, None])
        backs = []
        for t in range(1, longest):
            m = int(going[t])
            prev = best[:, :m]
            top = prev[0] + self.trans[0][:, None]
            arg = np.zeros((k, m), np.int8)
            for f in range(1, k):
                way = prev[f] + self.trans[f][:, None]
                np.putmask(arg, way > top, np.int8(f))
                np.maximum(top, way, out=top)
            best[:, :m] = top + score[at[:m] + t].T
            backs.append(arg)
        best += np.where(last, 0, self.trans[:, 0][:, None])
        now = best.argmax(0)
        out[at + size - 1] = now
        for t in range(longest - 1, 0, -1):
            m = int(going[t])
            now[:m] = backs[t - 1][now[:m], np.arange(m)]
            out[at[:m] + t - 1] = now[:m]


def _sequences(table: list[list[tuple[str, str]]]) -> list[tuple[list[str], np.ndarray]]:
    out = []
    for pieces in table:
        text, marks = "", []
        for t, kind in pieces:
            if kind:
                marks.append((len(text), len(text) + len(t), kind))
            text += t
        toks = tokens(text)
        begin, end = np.array(places(text, len(toks))).reshape(-1, 2).T
        lab = np.zeros(len(toks), np.int64)
        for a, b, kind in marks:
            inside = np.flatnonzero((begin >= a) & (end <= b))
            lab[inside] = LABELS.index(f"I-{kind}")
            lab[inside[:1]] = LABELS.index(f"B-{kind}")
        if len(toks):
            out.append((toks, lab))
    return out


def train(table: list[list[tuple[str, str]]], epochs: int = 12, rate: float = 0.08, decay: float = 2e-5, seed: int = 5) -> Field:
    """Maximum likelihood by Adam over batches of sentences, with forward-backward sums."""
    seqs = _sequences(table)
    seen: dict[str, int] = {}
    for toks, _ in seqs:
        for t in toks:
            for f in features(t):
                seen[f] = seen.get(f, 0) + 1
    known = {f: i for i, f in enumerate(f for f, c in seen.items() if c >= 4)}
    k, nf, no = len(LABELS), len(known), 2 * REACH + 1
    width = 6
    feats: dict[str, list[int]] = {}
    for toks, _ in seqs:
        for t in toks:
            if t not in feats:
                ids = [known[f] for f in features(t) if f in known]
                feats[t] = ids + [nf] * (width - len(ids))  # nf: nothing
    w = np.zeros((no, nf + 1, k))
    trans, start = np.zeros((k, k)), np.zeros(k)
    for a, la in enumerate(LABELS):  # an inside label only goes on with its own kind
        for b, lb in enumerate(LABELS):
            if lb[0] == "I" and la[2:] != lb[2:]:
                trans[a, b] = -20.0
    for b, lb in enumerate(LABELS):
        if lb[0] == "I":
            start[b] = -20.0
    fixed = (trans == 0, start == 0)
    params = [w, trans, start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step = np.random.default_rng(seed), 0
    order = np.argsort([len(s[0]) for s in seqs], kind="stable")
    batches = [order[a : a + 50] for a in range(0, len(order), 50)]
    for epoch in range(epochs):
        for batch in rng.permutation(len(batches)):
            part = [seqs[i] for i in batches[batch]]
            n, size = len(part), max(len(s[0]) for s in part)
            code = np.full((n, size + 2 * REACH, width), nf)
            lab, real = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
            for i, (toks, y) in enumerate(part):
                code[i, REACH : REACH + len(toks)] = [feats[t] for t in toks]
                lab[i, : len(toks)], real[i, : len(toks)] = y, True
            score = sum(w[o][code[:, o : o + size]].sum(2) for o in range(no))
            alpha, beta = np.empty((n, size, k)), np.zeros((n, size, k))
            alpha[:, 0] = start + score[:, 0]
            e = np.exp(trans)
            for t in range(1, size):
                top = alpha[:, t - 1].max(1, keepdims=True)
                nxt = np.log(np.exp(alpha[:, t - 1] - top) @ e + 1e-300) + top + score[:, t]
                alpha[:, t] = np.where(real[:, t, None], nxt, alpha[:, t - 1])
            for t in range(size - 2, -1, -1):
                s = beta[:, t + 1] + score[:, t + 1]
                top = s.max(1, keepdims=True)
                prev = np.log(np.exp(s - top) @ e.T + 1e-300) + top
                beta[:, t] = np.where(real[:, t + 1, None], prev, 0)
            z = np.log(np.exp(alpha[:, -1] - alpha[:, -1].max(1, keepdims=True)).sum(1)) + alpha[:, -1].max(1)
            prob = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
            gold = np.zeros_like(prob)
            gold[np.arange(n)[:, None], np.arange(size), lab] = 1
            delta = (prob - gold * real[..., None]) / n
            gw = np.zeros_like(w)
            for o in range(no):
                for j in range(width):
                    np.add.at(gw[o], code[:, o : o + size, j][real], delta[real])
            gw[:, nf] = 0
            gt = np.zeros_like(trans)
            for t in range(1, size):
                on = real[:, t]
                if not on.any():
                    break
                pair = alpha[on, t - 1][:, :, None] + trans + (score[on, t] + beta[on, t])[:, None, :] - z[on, None, None]
                gt += np.exp(pair).sum(0)
                np.add.at(gt, (lab[on, t - 1], lab[on, t]), -1)
            gt /= n
            gs = (prob[:, 0] - gold[:, 0]).sum(0) / n
            step += 1
            lr = rate * (1 - (step - 1) / (epochs * len(batches)))
            for i, (p, g) in enumerate(zip(params, (gw, gt * fixed[0], gs * fixed[1]))):
                g = g + decay * p * (i == 0)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p -= lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(known, w[:, :nf].astype(np.float32), trans.astype(np.float32), start.astype(np.float32))


WEIGHTS = "pii_weights.npz"


def pack_field(model: Field) -> bytes:
    """The weights as bytes, in half precision, with the smallest ones as zero."""
    w = np.where(np.abs(model.weights) < 0.02, 0, model.weights).astype(np.float16)
    names = "\n".join(sorted(model.known, key=model.known.get)).encode()
    out = io.BytesIO()
    np.savez_compressed(out, names=np.frombuffer(names, np.uint8), weights=w, trans=model.trans, start=model.start)
    return out.getvalue()


def unpack_field(data: bytes) -> Field:
    z = np.load(io.BytesIO(data))
    known = {f: i for i, f in enumerate(z["names"].tobytes().decode().split("\n"))}
    return Field(known, z["weights"].astype(np.float32), z["trans"], z["start"])


@lru_cache(maxsize=1)
def field() -> Field:
    """The field with the stored weights."""
    return unpack_field(resources.files("clauseflow.llm").joinpath(WEIGHTS).read_bytes())


# ---------------------------------------------------------------- finding and masking


def find(texts: list[str], model: Field) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) of the personal data in each text."""
    cut = [tokens(t) for t in texts]
    labels = model.label(cut)
    out, base = [], 0
    for text, toks in zip(texts, cut):
        lab = labels[base : base + len(toks)]
        base += len(toks)
        some = np.flatnonzero(lab)
        if not len(some):
            out.append([])
            continue
        at = places(text, int(some[-1]) + 1)
        spans: list[list] = []
        for i in some.tolist():
            name = LABELS[lab[i]]
            if name[0] == "B" or not spans or spans[-1][2] != name[2:] or spans[-1][3] != i - 1:
                spans.append([*at[i], name[2:], i])
            else:
                spans[-1][1], spans[-1][3] = at[i][1], i
        found = []
        for a, b, kind, _ in spans:
            a, b = checked(text, a, b, kind)
            if found and found[-1][2] == kind and a <= found[-1][1] < b:  # a value that was completed into the one before it
                found[-1] = (found[-1][0], b, kind)
            elif a < b and (not found or a >= found[-1][1]):
                found.append((a, b, kind))
        out.append(found)
    return out


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """An exact check of a span that the field found: signs that no value begins or ends with fall off, a value of which
    the field saw a part is completed to whole words, and a span without what its kind is made of is none."""
    while a < b and not (text[a].isdigit() or text[a] in "+(" if kind == "phone" else text[a].isalnum()):
        a += 1
    while b > a and not (text[b - 1].isalnum() or (kind == "person" and text[b - 1] == "." and text[b - 2 : b - 1].isalpha() and not text[max(a, b - 3) : b - 2].isalpha())):
        b -= 1
    if a >= b:
        return a, a
    while a > 0 and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while kind == "email" and a > 0 and (text[a - 1].isalnum() or (text[a - 1] in "._+-" and a > 1 and text[a - 2].isalnum())):
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and (text[b].isalnum() or (kind == "email" and text[b] in ".-" and text[b + 1 : b + 2].isalnum())):
        b += 1
    if kind == "person" and a >= 2 and text[a - 1].isspace() and text[a - 2] == ".":  # an initial set apart
        if a >= 3 and text[a - 3].isupper() and not text[max(0, a - 4) : a - 3].isalnum():
            a -= 3
    if kind == "person" and b < len(text) and text[b] == "." and text[b - 1].isupper() and not text[max(0, b - 2) : b - 1].isalnum():
        b += 1  # the stop of a last initial
    if kind == "phone" and a >= 1 and text[a - 1] == "+":
        a -= 1
    if kind == "id_number":  # groups of the same number, on both sides, however many
        while (n := _group_before(text, a)) is not None:
            a = n
        while (n := _group_after(text, b)) is not None:
            b = n
    value = text[a:b]
    if kind == "phone" and value[0] == "(" and ")" not in value:  # the bracket belongs to the sentence
        a, value = a + 1, value[1:]
    if kind == "email" and ". " in value:  # the end of a sentence
        value = value[: value.index(". ")]
        b = a + len(value)
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        ok = len(value) >= 5 and (any(c in "@＠" for c in value) or sum(not c.isalnum() for c in value) >= 3)
    elif kind == "phone":
        ok = digits >= 5
    elif kind == "id_number":
        ok = digits >= 5
    elif kind == "address":
        ok = sum(c.isalpha() for c in value) >= 2
    else:
        ok = sum(c.isalpha() for c in value) >= 2 and digits == 0
    return (a, b) if ok else (a, a)


def _group_before(text: str, a: int) -> int | None:
    """Where the group of digits before place a begins, if one blank or hyphen joins it to what follows."""
    if a < 2 or not text[a].isdigit() or text[a - 1] not in " -\u00a0" or not text[a - 2].isdigit():
        return None
    i = a - 2
    while i > 0 and text[i - 1].isdigit():
        i -= 1
    return None if i > 0 and (text[i - 1].isalnum() or text[i - 1] in ".,/-") else i


def _group_after(text: str, b: int) -> int | None:
    if b + 1 >= len(text) or not text[b - 1].isdigit() or text[b] not in " -\u00a0" or not text[b + 1].isdigit():
        return None
    i = b + 1
    while i + 1 < len(text) and text[i + 1].isdigit():
        i += 1
    return i + 1


def _batches(texts: list[str], most: int = 2_000_000):
    """Consecutive texts of bounded length together, however long one of them is."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def personal_data(documents: DataFrame, model: Field | None = None) -> DataFrame:
    """(doc_id, kind, found_text): each distinct value in each document, exactly as written there.

    documents: doc_id, text. Null ids and texts are left out, empty texts give nothing; a document delivered twice counts once;
    texts are read whole, however long; other columns play no part.
    """
    model = model or field()

    def run(batches):
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            rows = set()
            for a, b in _batches(texts):
                for i, spans in enumerate(find(texts[a:b], model), a):
                    rows.update((int(ids[i]), kind, texts[i][x:y]) for x, y, kind in spans)
            yield pd.DataFrame(sorted(rows), columns=["doc_id", "kind", "found_text"]).astype({"doc_id": "int64"})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.mapInPandas(run, "doc_id long, kind string, found_text string").distinct()


def masked(documents: DataFrame, model: Field | None = None) -> DataFrame:
    """(doc_id, masked_text, n_masked): the text with a typed placeholder in place of each value, otherwise unchanged.

    A null text stays null with 0 values; rows with a null id are left out; every row gives one row.
    """
    model = model or field()

    def run(batches):
        for pdf in batches:
            texts, out, counts = pdf["text"].tolist(), [], []
            for a, b in _batches([t or "" for t in texts]):
                for t, spans in zip(texts[a:b], find([t or "" for t in texts[a:b]], model)):
                    parts, at = [], 0
                    for x, y, kind in spans:
                        parts += [t[at:x], PLACEHOLDER[kind]]
                        at = y
                    out.append(None if t is None else "".join(parts) + t[at:])
                    counts.append(len(spans))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "masked_text": out, "n_masked": np.array(counts, np.int64)})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return docs.mapInPandas(run, "doc_id long, masked_text string, n_masked long")


if __name__ == "__main__":
    from pathlib import Path

    Path(__file__).with_name(WEIGHTS).write_bytes(pack_field(train(labelled(), epochs=8)))
