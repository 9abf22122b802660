"""Evaluation texts leaking into a corpus: BM25 over the test items, block-max WAND, run of words, question and answer.

The test items are the indexed side. An inverted index holds, for each word, the blocks of items that have it with the
largest BM25 impact inside the block, and the items themselves with their impacts. Every passage of every corpus document is a
query, a batch at a time:

* the pivot: words of a passage in ascending order of their largest impact; as long as their sum stays under the smallest
  limit they can't make a hit on their own, so only postings of the words from the pivot on are opened;
* the block maxima: a block so found is left if its maxima of these words, with what the words before the pivot may add, stay
  under the block's limit; items of the other blocks are looked at the same way, with their own impacts and limits;
* what is left is scored on all words, and every item above its own limit is retrieved (no top k).

The limit loses nothing: for an item, the smallest sum of impacts over any RUN consecutive words of it is a
lower bound for the score of any passage that holds such a run. Passages of 2 * RUN - 1 words start every RUN words, so each
run of RUN words lies whole in one of them. Hits are then verified on the words, and for the report on question and answer.

Counts of words and lengths are taken over all items, however the index is split.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.session import Shelf

RUN = 13
BLOCK = 16
#: Postings of one index, which goes to every executor: about 20 bytes each, so 100 MB, some 100,000 items of usual length.
#: More items are searched in further passes over the corpus, with the same scores.
INDEX_POSTINGS = 5_000_000
K1, B = 1.5, 0.75
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


class Postings:
    """Sparse (word, place) -> value, as sorted keys."""

    def __init__(self, word: np.ndarray, place: np.ndarray, value: np.ndarray, places: int, n_words: int):
        self.places = max(places, 1)
        key = word.astype(np.int64) * self.places + place
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.value = key[order], place[order].astype(np.int64), value[order]
        self.start = np.searchsorted(self.key, np.arange(n_words + 2, dtype=np.int64) * self.places)

    def opened(self, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, sum of values) over all postings of the given words of each row."""
        first, count = self.start[word], self.start[word + 1] - self.start[word]
        at = np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)
        key = np.repeat(row, count) * self.places + self.place[at]
        size = (int(row[-1]) + 1) * self.places if len(row) else 0
        if size <= 4 * len(key) + 4096:
            total = np.bincount(key, self.value[at], size)
            key = np.flatnonzero(total)
            total = total[key]
        else:
            key, where = np.unique(key, return_inverse=True)
            total = np.bincount(where, self.value[at], len(key))
        return key // self.places, key % self.places, total

    def sums(self, w: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each row of words the sum of their values at a place."""
        total = np.zeros(len(w))
        if not len(self.key):
            return total
        for k in range(w.shape[1]):
            key = w[:, k] * self.places + place
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            total += np.where(self.key[at] == key, self.value[at], 0.0)
        return total


class Index:
    """Block-max index of items = [(item_id, words)]; df, n and mean: counts over all items, those of other indexes included."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int] | None = None, n: int | None = None, mean: float | None = None, run: int = RUN):
        self.run, self.passage = run, 2 * run - 1
        items = [(i, w) for i, w in items if len(w) >= run]  # a shorter item holds no run
        self.ids = np.array([i for i, _ in items], np.int64)
        self.vocab: dict[str, int] = {}
        seqs = [np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64) for _, w in items]
        v = len(self.vocab)
        if df is None:
            df = Counter(x for _, w in items for x in set(w))
            n, mean = len(items), sum(len(w) for _, w in items) / max(1, len(items))
        freq = np.fromiter((df[x] for x in self.vocab), np.float64, v)
        idf = np.log1p((n - freq + 0.5) / (freq + 0.5))
        word, place, value, least = [], [], [], []
        for j, s in enumerate(seqs):
            t, c = np.unique(s, return_counts=True)
            impact = idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(s) / mean))
            word.append(t), place.append(np.full(len(t), j)), value.append(impact)
            of = dict(zip(t.tolist(), impact.tolist()))
            seq = s.tolist()
            least.append(min(sum(of[x] for x in set(seq[a : a + run])) for a in range(len(seq) - run + 1)) * (1 - 1e-9))
        none = np.zeros(0)
        word, place, value = (np.concatenate(x) if x else none for x in (word, place, value))
        word, place = word.astype(np.int64), place.astype(np.int64)
        self.least = np.array(least)
        # items alike in limit side by side: a block's limit is its smallest
        block_of = np.empty(len(items), np.int64)
        block_of[np.argsort(self.least, kind="stable")] = np.arange(len(items)) // BLOCK
        self.members = np.full((-(-len(items) // BLOCK), BLOCK), -1, np.int64)
        for j, b in enumerate(block_of):
            self.members[b, np.flatnonzero(self.members[b] < 0)[0]] = j
        self.block_of = block_of
        self.block_least = np.array([self.least[m[m >= 0]].min() for m in self.members]) if len(items) else none
        self.exact = Postings(word, place, value, len(items), v)
        key = word * max(1, len(self.members)) + (block_of[place] if len(items) else place)
        order = np.lexsort((-value, key))
        top = order[np.r_[True, np.diff(key[order]) > 0]] if len(order) else order
        self.blocks = Postings(word[top], block_of[place[top]] if len(items) else place[top], value[top], len(self.members), v)
        self.word_max = np.zeros(v + 1)  # the last one is any word outside the items
        np.maximum.at(self.word_max, word, value)
        self.seqs = seqs
        self._windows: dict[int, set[bytes]] = {}

    def windows(self, j: int) -> set[bytes]:
        out = self._windows.get(j)
        if out is None:
            if len(self._windows) > 20_000:
                self._windows.clear()
            s = self.seqs[j].astype(np.int32)
            out = self._windows[j] = {s[a : a + self.run].tobytes() for a in range(len(s) - self.run + 1)}
        return out

    def passages(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the items' limits; a passage is codes[start:end] of words' numbers."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if not len(self.ids) or not len(starts):
            return none
        outside, low = len(self.vocab), self.block_least.min()
        total = np.r_[0.0, np.cumsum(self.word_max[codes])]
        live = np.flatnonzero(total[ends] - total[starts] >= low * (1 - 1e-6) - 1e-6)  # repeated words counted: a bound
        out = []
        step = max(64, min(8192, 4_000_000 // len(self.members)))
        for a in range(0, len(live), step):
            part = live[a : a + step]
            spot = starts[part][:, None] + np.arange(self.passage)
            w = np.where(spot < ends[part][:, None], codes[np.minimum(spot, len(codes) - 1)], outside)
            w = np.sort(w, axis=1)
            w[:, 1:][w[:, 1:] == w[:, :-1]] = outside  # a repeated word counts once
            bound = self.word_max[w]
            order = np.argsort(bound, axis=1)
            w, bound = np.take_along_axis(w, order, 1), np.take_along_axis(bound, order, 1)
            upto = np.cumsum(bound, axis=1)
            ahead = upto >= low  # from the pivot on
            rest = np.where(ahead, 0, bound).sum(1)  # what the words before it may add at most
            ahead &= w != outside
            row, k = np.nonzero(ahead)
            row, block, got = self.blocks.opened(row, w[row, k])
            keep = got + rest[row] >= self.block_least[block]
            open_ = np.zeros((len(w), len(self.members)), bool)
            open_[row[keep], block[keep]] = True
            ahead &= open_.any(1)[:, None]
            row, k = np.nonzero(ahead)
            row, item, got = self.exact.opened(row, w[row, k])
            keep = (got + rest[row] >= self.least[item]) & open_[row, self.block_of[item]]
            row, item = row[keep], item[keep]
            score = self.exact.sums(w[row], item)
            hit = score >= self.least[item]
            out.append((part[row[hit]], item[hit], score[hit]))
        return tuple(map(np.concatenate, zip(*out))) if out else none

    def search(self, texts: list[str]) -> list[tuple[int, int, list[int], float, list[str]]]:
        """(place of the text, number of the item in the index, starts of common runs, best score, words of the text)."""
        get, none = self.vocab.get, len(self.vocab)
        split = [words(t) for t in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((get(x, none) for w in split for x in w), np.int32, int(lens.sum()))
        ends = np.cumsum(lens)
        firsts = ends - lens
        counts = np.maximum(-(-(lens - self.run + 1) // self.run), 0)  # passages of each text
        doc = np.repeat(np.arange(len(split)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = firsts[doc] + nth * self.run
        stops = np.minimum(starts + self.passage, ends[doc])
        found: dict[tuple[int, int], list] = {}
        for p, j, s in zip(*self.passages(codes, starts, stops)):
            runs = self.windows(int(j))
            for a in range(starts[p], stops[p] - self.run + 1):
                if codes[a : a + self.run].tobytes() in runs:
                    best = found.setdefault((int(doc[p]), int(j)), [0.0, set()])
                    best[0] = max(best[0], float(s))
                    best[1].add(int(a - firsts[doc[p]]))
        return [(d, j, sorted(at), score, split[d]) for (d, j), (score, at) in found.items()]

    def shared(self, j: int, w: list[str], at: list[int]) -> tuple[int, float]:
        """Words in the longest common run, and the share of the item's distinct runs that the text holds."""
        longest, length, before = self.run, self.run, None
        for a in at:
            length = length + 1 if before is not None and a == before + 1 else self.run
            longest, before = max(longest, length), a
        return longest, len({tuple(w[a : a + self.run]) for a in at}) / len(self.windows(j))


def _holds(w: list[str], part: list[str]) -> bool:
    """Whether words stand one after another among others."""
    return bool(part) and f" {' '.join(part)} " in f" {' '.join(w)} "


_FOUND = "doc_id long, item_id long, run_words long, score double, question_share double, answer_found boolean"


def _searcher(index: Index, answers: dict[int, list[list[str]]]):
    def run(batches):
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy()
            size, part = 0, []
            rows: list[tuple] = []
            for i, t in enumerate(texts):  # batches of bounded length, however long the texts
                part.append(i)
                size += len(t)
                if size > 4_000_000 or i == len(texts) - 1:
                    for d, j, at, score, w in index.search([texts[k] for k in part]):
                        item = int(index.ids[j])
                        longest, share = index.shared(j, w, at)
                        rows.append((ids[part[d]], item, longest, score, share, any(_holds(w, x) for x in answers.get(item, ()))))
                    size, part = 0, []
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "run_words", "score", "question_share", "answer_found"])
            yield out.astype({"doc_id": "int64", "item_id": "int64", "run_words": "int64", "score": "float64", "question_share": "float64", "answer_found": "bool"})

    return run


def _cut(batches):
    for pdf in batches:
        yield pd.DataFrame({"item_id": pdf["item_id"], "w": [words(t) for t in pdf["text"]], "a": [words(t or "") for t in pdf["answer"]]})


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, index_postings: int = INDEX_POSTINGS) -> DataFrame:
    """(doc_id, item_id, run_words, score, question_share, answer_found): documents that hold at least `run` consecutive words of an item.

    question_share: share of the item's runs that stand in the document; answer_found: whether the item's answer does, word by
    word. documents: doc_id, text; items: item_id, text and, if there is one, answer. Null ids and texts are left out, as are
    items of fewer than `run` words; a document or item delivered twice counts once; an item_id with several texts is searched for
    with each of them, and the largest figures are given; documents are searched whole, however long; no items give an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    cut = items.select("item_id", "text", answer.alias("answer")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    shelf = Shelf(spark, "leaks")
    entries = shelf.put(cut.mapInPandas(_cut, "item_id long, w array<string>, a array<string>").filter(F.size("w") >= run))
    texts = entries.select("item_id", "w").distinct()
    n, mean, postings = texts.agg(F.count("*"), F.avg(F.size("w")), F.sum(F.size(F.array_distinct("w")))).first()
    freq = texts.select(F.explode(F.array_distinct("w")).alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    parts = max(1, -(-(postings or 0) // index_postings))
    out = None
    for p in range(parts):  # one, but for more than index_postings
        mine = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p
        here = texts.filter(mine)
        rows = sorted((r[0], r[1]) for r in here.collect())  # bounded by index_postings
        df = dict(map(tuple, freq.join(here.select(F.explode("w").alias("x")).distinct(), "x").collect())) if rows else {}
        answers: dict[int, list[list[str]]] = {}
        for i, a in entries.filter(mine).select("item_id", "a").distinct().collect():
            answers.setdefault(i, []).append(a)
        found = docs.mapInPandas(_searcher(Index(rows, df, n, mean, run), answers), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("run_words", "score", "question_share", "answer_found")])
