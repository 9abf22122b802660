"""Variant spellings of units and persons: a trie join under Levenshtein automata, then word orders.

The words of the registry's names stand in tries. A word as someone wrote it runs through a trie as the pattern of a
bit-parallel Levenshtein automaton (insertions, deletions, substitutions, swapped neighbours): branches are left as soon as
no state is alive, so only words within the allowed distance are reached; beginnings of words, whole or misspelt, are found
by the same traversal. Readings of the words of a spelling are then followed through a tree of the entities' names in the orders in
which names are written, so only combinations that some entity has are looked at.

The registry is a table: it is split by hash into shards of about SHARD_ENTITIES, each distinct spelling meets every
shard once, and readings come back with their costs. Which reading is best, and whether two entities tie, is decided over
all shards, so the result doesn't depend on how the registry is split.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.llm.textform import canonical_text
from clauseflow.session import Shelf

#: Entities and distinct spellings that one task holds, about.
SHARD_ENTITIES = 20_000
SPELLINGS_A_TASK = 20_000
MOST_COST = 3.5

# Short forms of given names in everyday use.
_NICK = """
Александр=Александра Саша Шура Саня Сашка Санёк|Алексей Алёша Лёша Лёха Алёшка|Алевтина Аля Алевтинка Тина|Анатолий Толя Толик|Анастасия Настя Настенька Ася|Андрей Андрюша Дрюша|Анна Аня Нюра Анечка Аннушка Нюша|Антон Антоша Тоша
Антонина Тоня|Аркадий Аркаша|Арсений Сеня Арсюша Арсик|Артём Тёма|Богдан Бодя Богдаша Даня|Борис Боря Борька|Вадим Вадик Вадя Дима|Валентин=Валентина Валя|Валерий Валера|Валерия Лера|Варвара Варя Варенька Варюша|Василий Вася Василёк|Вера Верочка|Вероника Ника
Виктор Витя|Виктория Вика|Виталий Виталик Виталя|Владимир Володя Вова Вовка|Владислав Влад Владик Слава|Вячеслав Слава|Галина Галя Галка Галюша|Геннадий Гена|Георгий Жора Гоша|Герман Гера|Глеб Глебушка|Григорий Гриша Гриня Гришаня|Даниил=Данила Даня|Дарья Даша Дашенька Дашуля|Демьян Дема Дёма Демьяша|Денис Дениска|Дмитрий Дима Митя
Евгений=Евгения Женя Женька Жека|Егор Егорка|Екатерина Катя Катерина Катюша|Елена Лена Алёна Леночка|Елизавета Лиза Лизавета Лизонька|Ефим Фима|Жанна Жанночка|Захар Зора Захарка Захарик|Зинаида Зина Зиночка Зинуля|Зоя Зоенька|Иван Ваня Ванька|Игнат Игнаша Игнатик Игнаха|Игорь Игорёк Гоша|Илья Илюша|Инна Инуся Инночка Инка|Иннокентий Кеша|Ирина Ира Ириша
Кирилл Кира Кирюша Кирилка|Клавдия Клава Клаша Клавочка|Константин Костя|Ксения Ксюша|Лариса Лара|Лев Лёва|Леонид Лёня Леня Лёнька|Лидия Лида Лидочка Лидуся|Любовь Люба|Людмила Люда Мила Люся|Макар Макарка|Максим Макс|Маргарита Рита Марго Ритуля|Марина Мариша|Мария Маша Маруся Машенька|Матвей Мотя|Михаил Миша Мишаня Михась
Надежда Надя Наденька Надюша|Наталья=Наталия Наташа Ната|Никита Никитка|Николай Коля Николаша Колян|Нина Ниночка|Оксана Ксана|Олег Олежка Олежек|Ольга Оля Олечка|Павел Паша Павлик|Пелагея Поля|Пётр Петя Петруша Петька|Полина Поля Полинка Полюша|Прасковья Паша|Раиса Рая Раечка Раюша|Родион Родя|Роман Рома Ромаша Ромка|Руслан Руслик
Савелий Сава Савва Савушка|Светлана Света Светик Лана|Семён Сёма|Сергей Серёжа Серёга|София=Софья Соня|Станислав Стас Слава|Степан Стёпа|Тамара Тома Томочка Тамарочка|Татьяна Таня Танюша|Тимофей Тима Тимоша Тимка|Тимур Тима|Ульяна Уля|Фёдор Федя Фёдя Федюша|Филипп Филя|Эдуард Эдик|Элеонора Эля|Юлия Юля Юленька Юляша|Юрий Юра Юрик Юраша|Яков Яша Яшка Яня|Ярослав Слава Ярик
"""  # fmt: skip
# Forms of address, and posts that stand beside a person's name.
_BESIDE = set("господин госпожа гражданин гражданка тов товарищ доктор профессор старший старшая главный главная ведущий ведущая младший младшая директор заместитель начальник заведующий заведующая бухгалтер секретарь юрист юрисконсульт экономист инженер мастер бригадир менеджер специалист консультант администратор программист водитель курьер кладовщик диспетчер ревизор аудитор аналитик контролер куратор инспектор эксперт технолог методист методолог руководитель координатор архивариус делопроизводитель референт советник помощник".split())
# Transcription of Russian letters.
_LATIN = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэюя", "a b v g d e z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" "))) | {"ж": "zh"}

_FIRM = re.compile(r"(?i)\b(?:ао|ооо|пао|зао|оао|нао)\s*[«\"“][^»\"”]*[»\"”]?")
_ADDRESS = re.compile(r"(?i)\bг-(?:н|на|ну|ном|не|жа|жи|же|жу|жой)\b\.?")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?\.?")


def fold(text: str) -> str:
    return text.lower().replace("ё", "е")


def latin(word: str) -> str:
    return "".join(_LATIN.get(c, c) for c in word)


class Trie:
    """Words in a trie. `near` enumerates those within k edits of a pattern, `starting` those that begin with one, `begun` those
    of which some beginning is within k edits of it."""

    def __init__(self, words):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in sorted(set(words)):
            at = 0
            for c in w:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                at = to
            self.word[at] = w

    def near(self, pattern: str, k: int) -> list[tuple[str, int]]:
        """[(word, distance)] with distance <= k."""
        out = []
        for at, d in self._walk(pattern, k):
            if self.word[at] is not None:
                out.append((self.word[at], d))
        return out

    def starting(self, prefix: str) -> list[str]:
        at = 0
        for c in prefix:
            at = self.next[at].get(c)
            if at is None:
                return []
        return self._below(at)

    def begun(self, pattern: str, k: int) -> list[str]:
        found: set[str] = set()
        for at, _ in self._walk(pattern, k):
            found.update(self._below(at))
        return sorted(found)

    def _below(self, at: int) -> list[str]:
        out, stack = [], [at]
        while stack:
            at = stack.pop()
            if self.word[at] is not None:
                out.append(self.word[at])
            stack.extend(self.next[at].values())
        return out

    def _walk(self, pattern: str, k: int):
        """(node, distance) of the beginnings within k edits of the pattern. Bit i of state d: the pattern's first i letters read with at most d edits."""
        m = len(pattern)
        masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << i
        full, goal = (1 << (m + 1)) - 1, 1 << m
        zero = (0,) * (k + 1)
        stack = [(0, tuple((1 << (d + 1)) - 1 for d in range(k + 1)), zero, 0)]
        while stack:
            at, state, before, mask_before = stack.pop()
            for c, to in self.next[at].items():
                mask = masks.get(c, 0)
                prev = (state[0] & mask) << 1
                new = [prev]
                for d in range(1, k + 1):
                    low = state[d - 1]
                    prev = ((state[d] & mask) << 1 | low | low << 1 | prev << 1 | ((((before[d - 1] & mask) << 1) & mask_before) << 1)) & full
                    new.append(prev)
                if not prev:
                    continue
                if prev & goal:
                    yield to, next(d for d in range(k + 1) if new[d] & goal)
                if self.next[to]:
                    stack.append((to, tuple(new), state, mask))


class Names:
    """The tries and trees of a shard of entities [(entity_id, kind, name)].

    A reading is (entity_id, kind, round, cost, read): kind 'u' or 'p'; round: edits in the surname, of which fewer go first;
    read: the words of the spelling that were not read as they stand.
    """

    def __init__(self, entities: list[tuple[int, str, str]]):
        self.tree: dict = {}
        self.acronym: dict[str, set[int]] = {}
        self.part_acronym: dict[tuple[str, str], set[int]] = {}
        self.persons: dict[str, list[tuple[int, str, str]]] = {}
        kinds, words = set(), set()
        for i, kind, name in entities:
            w = name_words(name)
            if kind == "unit" and len(w) >= 2:
                at = self.tree.setdefault(len(w), {})
                for x in w:
                    at = at.setdefault(x, {})
                at.setdefault("", []).append(i)
                kinds.add(w[0])
                words.update(w)
                self.acronym.setdefault("".join(x[0] for x in w), set()).add(i)
                self.part_acronym.setdefault((w[0], "".join(x[0] for x in w[1:])), set()).add(i)
            elif kind == "person" and w:
                who = (i, w[1] if len(w) > 1 else "", w[2] if len(w) > 2 else "")
                self.persons.setdefault(w[0], []).append(who)
                self.persons.setdefault(latin(w[0]), []).append((i, latin(who[1]), latin(who[2])))
        self.kinds, self.words = kinds, words
        self.word_trie, self.person_trie = Trie(words), Trie(self.persons)
        self.nick: dict[str, set[str]] = {}
        for entry in re.split(r"[|\n]", fold(_NICK)):
            full, *short = entry.split() or [""]
            for s in short:
                for first in full.split("="):
                    self.nick.setdefault(s, set()).add(first)
                    self.nick.setdefault(latin(s), set()).add(latin(first))
        self.seen: dict[tuple, list] = {}

    # -- units

    def _word(self, token: str) -> list[tuple[str, float]]:
        """Registry words that a token of a unit's name may stand for. What a token costs as a word depends on the two only."""
        found = self.seen.get(("u", token))
        if found is not None:
            return found
        core, dotted = token.rstrip("."), token.endswith(".")
        cost: dict[str, float] = {}

        def add(words, c):
            for w in words:
                cost[w] = min(cost.get(w, 9.0), c)

        if core in self.words:
            cost[core] = 0.0
        else:
            if "-" in core:
                a, b = core.split("-", 1)
                add((w for w in self.word_trie.starting(a) if w.endswith(b) and len(w) > len(a) + len(b)), 0.3)
            if len(core) >= 3 and core[-1] not in VOWELS and core[-2] not in VOWELS:  # first letters and last ones, without a hyphen
                add((w for w in self.word_trie.starting(core[:3]) if w in self.kinds and len(w) > len(core) + 2 and _skips(core, w)), 0.3)
            if dotted:
                add((w for w in self.word_trie.starting(core) if len(core) >= 3 or w in self.kinds), 0.2)
            elif len(core) >= 3:
                add(self.word_trie.starting(core), 0.6)
            if len(core) >= 4:
                for w, d in self.word_trie.near(core, 2 if len(core) >= 5 else 1):
                    add((w,), float(d))
                if dotted:  # a shortened word with a typing error
                    add((w for w in self.word_trie.begun(core, 1) if len(w) > len(core)), 1.2)
        if len(self.seen) > 300_000:
            self.seen.clear()
        out = self.seen["u", token] = sorted(cost.items())
        return out

    def unit(self, text: str) -> list[tuple]:
        """Readings of a unit's spelling."""
        t = _FIRM.sub(" ", text)
        tokens = _WORDS.findall(fold(t))
        letters = "".join(x.rstrip(".") for x in tokens)
        if len(tokens) > 2 and all(len(x.rstrip(".")) == 1 for x in tokens):
            return [(i, "u", 0, 0.5, ()) for i in self.acronym.get(letters, ())]
        tokens = [x for x in tokens if x != "и"]
        if not tokens:
            return []
        if len(tokens) == 1 and 3 <= len(letters) <= 6 and "-" not in letters:
            return [(i, "u", 0, 0.5, ()) for i in self.acronym.get(letters, ())]
        out: dict[tuple[int, tuple], float] = {}

        def read(pairs):
            return tuple(sorted({x.rstrip(".") for x, c in pairs if c}))

        if len(tokens) == 2 and 2 <= len(tokens[1].rstrip(".")) <= 5:
            for w, c in self._word(tokens[0]):
                for i in self.part_acronym.get((w, tokens[1].rstrip(".")), ()):
                    out[i, read([(tokens[0], c)])] = min(out.get((i, read([(tokens[0], c)])), 9), c + 0.5)
            if len(tokens[1].rstrip(".")) < 4:
                return [(i, "u", 0, c, how) for (i, how), c in out.items()]
        tree = self.tree.get(len(tokens))
        if tree is None:
            return [(i, "u", 0, c, how) for (i, how), c in out.items()]
        n = len(tokens)
        for at in {0, n - 1}:  # the kind of unit comes first or last
            rest = tokens[:at] + tokens[at + 1 :]
            orders = [rest] + ([[rest[1], rest[2], rest[0]]] if n == 4 else [])  # 'B и [adjective] A' for '[adjective] A и B'
            for order in orders:
                states = [(tree, 0.0, ())]
                for x in (tokens[at], *order):
                    states = [(node[w], cost + c, (*how, (x, c))) for node, cost, how in states for w, c in self._word(x) if w in node and cost + c <= MOST_COST]
                for node, cost, how in states:
                    for i in node.get("", ()):
                        key = (i, read(how))
                        out[key] = min(out.get(key, 9), cost)
        return [(i, "u", 0, c, how) for (i, how), c in out.items()]

    # -- persons

    def _surnames(self, token: str, k: int) -> list[tuple[str, int]]:
        key = ("p", token, k)
        if key not in self.seen:
            self.seen[key] = [(token, 0)] if k == 0 and token in self.persons else self.person_trie.near(token, k) if k else []
        return self.seen[key]

    def _given(self, token: str, name: str) -> float | None:
        """The cost of reading a token as a given name or father's name; None if it can't be."""
        core = token.rstrip(".")
        if not name:
            return None
        if core == name:
            return 0.0
        if len(core) == 1 or (token.endswith(".") and len(core) <= 4):
            return 0.1 if name.startswith(core) else None
        if name in self.nick.get(core, ()):
            return 0.2
        key = ("g", core, name)
        if key not in self.seen:
            near = Trie([name]).near(core, 2 if len(name) >= 5 else 1)
            self.seen[key] = near[0][1] if near else None
        return self.seen[key]

    def person(self, text: str) -> list[tuple]:
        """Readings of a person's spelling: those with the fewest edits in the surname. A surname of any length is tried as it
        stands; one edit needs three letters; two need six letters, or four and a given name written out."""
        t = _ADDRESS.sub(" ", text)
        written = _WORDS.findall(t)
        tokens = [x for x in map(fold, written) if x.rstrip(".") not in _BESIDE]
        if len(tokens) > 3 or (1 < len(tokens) and any(x[0].islower() for x in written) and any(x[0].isupper() for x in written)):
            named = [x for x in map(fold, (x for x in written if x[0].isupper())) if x.rstrip(".") not in _BESIDE]
            if len(tokens) > 3 or (named and len(named) < len(tokens) and not self._persons(tokens)):  # words beside the name
                tokens = named
        return self._persons(tokens)

    def _persons(self, tokens: list[str]) -> list[tuple]:
        out: dict[int, float] = {}
        if not 1 <= len(tokens) <= 3:
            return []
        for k in (0, 1, 2):
            for at, token in enumerate(tokens):
                core = token.rstrip(".")
                if len(core) < (1, 3, 4)[k] or (len(core) == 1 and core != token):
                    continue
                rest = tokens[:at] + tokens[at + 1 :]
                if k == 2 and len(core) < 6 and not any(len(x.rstrip(".")) >= 3 for x in rest):
                    continue
                for surname, d in self._surnames(core, k):
                    for i, first, father in self.persons[surname]:
                        cost: float | None = d
                        for x, name in zip(rest, (first, father)):
                            c = self._given(x, name)
                            cost = None if c is None or cost is None else cost + c
                        if cost is not None and cost <= MOST_COST:
                            out[i] = min(out.get(i, 9), cost)
            if out:
                return [(i, "p", k, c, ()) for i, c in out.items()]
        return []

    def readings(self, spelling: str) -> list[tuple]:
        cyr = re.search("[А-Яа-яЁё]", spelling) is not None
        t = canonical_text(spelling) if cyr else spelling
        return (self.unit(t) if cyr else []) + self.person(t)

    def match(self, spelling: str) -> tuple[int, float] | None:
        """(entity_id, cost) of the one entity that explains a spelling best, were this shard the whole registry; None if there is none or several do."""
        all_ = [r for r in self.readings(spelling) if not self.words.intersection(r[4])]
        least = min((c for *_, c, _ in all_), default=None)
        best = {r[0] for r in all_ if r[3] == least}
        return (best.pop(), least) if len(best) == 1 else None


def name_words(name: str) -> list[str]:
    return [x for x in re.findall(r"[^\W\d_]+", fold(name)) if x != "и"]


VOWELS = set("аеиоуыэюя")


def _skips(short: str, word: str) -> bool:
    """Whether the letters of a shortened word stand in this order in the word, the first and the last at its ends."""
    it = iter(word)
    return short[0] == word[0] and short[-1] == word[-1] and all(c in it for c in short)


def _shard(entities: pd.DataFrame, spellings: pd.DataFrame) -> pd.DataFrame:
    """Readings of some spellings by one shard. Of readings alike in all but the entity two are enough: they show a tie."""
    rows = []
    if len(entities) and len(spellings):
        names = Names(list(entities[["entity_id", "kind", "name"]].itertuples(index=False, name=None)))
        for s in spellings["spelling"]:
            best: dict[tuple, list] = {}
            for i, kind, k, cost, read in names.readings(s):
                best.setdefault((kind, read), []).append((k, cost, i))
            for (kind, read), hits in best.items():
                k, cost, _ = min(hits)
                ids = sorted({i for a, b, i in hits if (a, b) == (k, cost)})
                rows.append((s, kind, k, cost, list(read), ids[0], len(ids) > 1))
    return pd.DataFrame(rows, columns=["spelling", "kind", "round", "cost", "read", "entity_id", "tied"])


_READINGS = "spelling string, kind string, round long, cost double, read array<string>, entity_id long, tied boolean"


def match_spellings(spellings: DataFrame, registry: DataFrame, shard_entities: int = SHARD_ENTITIES, a_task: int = SPELLINGS_A_TASK) -> DataFrame:
    """(spelling, entity_id, name): the registry entity that each distinct spelling means, if exactly one explains it best.

    spellings: spelling; registry: entity_id, kind, name. Null and repeated spellings, and registry rows with a null, are left out;
    one entity_id may have several names. A word of a spelling that is itself a word of some unit's name is read as no other.
    """
    shelf = Shelf(spellings.sparkSession, "spellings")
    known = registry.select("entity_id", "kind", "name").dropna().distinct()
    todo = shelf.put(spellings.select("spelling").filter("spelling IS NOT NULL").distinct())
    shards, parts = max(1, -(-known.count() // shard_entities)), max(1, -(-todo.count() // a_task))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.withColumn("shard", F.pmod(F.xxhash64("entity_id", "name"), F.lit(shards)).cast("int")).withColumn("part", every(parts))
    right = todo.withColumn("part", F.pmod(F.xxhash64("spelling"), F.lit(parts)).cast("int")).withColumn("shard", every(shards))
    read = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_shard, _READINGS)
    if shards > 1:  # a shard can't know the words of the others
        read = shelf.put(read)
        words = known.filter("kind = 'unit'").select(F.explode(F.regexp_extract_all(F.replace(F.lower("name"), F.lit("ё"), F.lit("е")), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).distinct()
        wrong = read.filter("size(read) > 0").select("spelling", "read", F.explode("read").alias("word")).join(words, "word", "left_semi").select("spelling", "read").distinct()
        read = read.join(wrong, ["spelling", "read"], "left_anti")
    # persons: the fewest edits in the surname first; then the least cost of all
    rounds = read.groupBy("spelling", "kind", "round", "cost").agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"), F.max("tied").alias("tied"))
    of_kind = rounds.groupBy("spelling", "kind").agg(F.min(F.struct("round", "cost", "low", "high", "tied")).alias("b"))
    by_cost = of_kind.groupBy("spelling", "b.cost").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"), F.max("b.tied").alias("tied"))
    best = by_cost.groupBy("spelling").agg(F.min(F.struct("cost", "low", "high", "tied")).alias("b")).filter("b.low = b.high AND NOT b.tied")
    official = known.select("entity_id", "name")
    return best.select("spelling", F.col("b.low").alias("entity_id")).join(official, "entity_id").select("spelling", "entity_id", "name")


def link_names(records: DataFrame, registry: DataFrame, shard_entities: int = SHARD_ENTITIES) -> DataFrame:
    """(origin, record_id, entity_id): records whose spelling means an entity but isn't its official name as written.

    records: origin, record_id, spelling. Null ids and spellings give no row, repeated rows count once, other columns play no part;
    a spelling that two entities explain equally well stays unlinked; an empty registry links nothing.
    """
    records = records.select("origin", "record_id", "spelling").filter("record_id IS NOT NULL AND spelling IS NOT NULL")
    hits = match_spellings(records, registry, shard_entities).groupBy("spelling", "entity_id").agg(F.max((F.col("spelling") == F.col("name")).cast("int")).alias("official"))
    return records.join(hits.filter("official = 0").select("spelling", "entity_id"), "spelling").select("origin", "record_id", "entity_id").distinct()
