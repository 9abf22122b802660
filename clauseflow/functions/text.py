"""Scalar text functions as column expressions: they stay in the JVM, inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from clauseflow.functions import lexicon as L

EDGE = r"[^\p{L}\p{N}_]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def value_of(make, *values: str | None):
    """What a column function gives for single strings; for a look at it, not for data."""
    spark = SparkSession.builder.getOrCreate()
    row = spark.range(1).select(make(*[F.lit(v).cast("string") for v in values]).alias("v")).first()[0]
    return row.asDict() if hasattr(row, "asDict") else row


def lower_e(text) -> Column:
    """Lower case, ё as е."""
    return F.replace(F.lower(_c(text)), F.lit("ё"), F.lit("е"))


def squeeze(text) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"[\s\p{Z}]+", " "))


def fold(text) -> Column:
    """Form for comparison: case folded (ß as ss), ё as е, single blanks."""
    return squeeze(F.replace(lower_e(text), F.lit("ß"), F.lit("ss")))


def norm(text) -> Column:
    """Lower case, ё as е, single blanks; null as ''."""
    return squeeze(lower_e(F.coalesce(_c(text), F.lit(""))))


def normalize_text(text) -> Column:
    """Key of exact equality: no enumerator at the start, no punctuation, lower case, ё as е; null as ''."""
    t = F.regexp_replace(lower_e(F.coalesce(_c(text), F.lit(""))), r"^\s*(?:\d+(?:\.\d+)*\.?|[а-яa-z]\))\s+", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def norm_lead(text) -> Column:
    """normalize_text without digits: '5.3. Director:' and '5.4. Director:' are equal."""
    return squeeze(F.regexp_replace(normalize_text(text), r"\d+", " "))


def quote_key(text) -> Column:
    """Form in which quotes are searched: lower case, ё as е, no quotation marks, no edge punctuation."""
    t = F.regexp_replace(lower_e(F.coalesce(_c(text), F.lit(""))), "[«»\"“”„']", "")
    return F.regexp_replace(F.regexp_replace(t, r"[\s\p{Z}]+", " "), r"^[ .;:,]+|[ .;:,]+$", "")


def stem(word: Column, endings: list[str] = L.ENDINGS, least: int = 4) -> Column:
    """Rough stem of a lower-case word of more than five letters: the longest ending that leaves `least` letters falls off."""
    ends = "|".join(sorted(endings, key=len, reverse=True))
    bare = F.regexp_replace(word, rf"^(.{{{least},}})(?:ся|сь)$", "$1")
    return F.when(F.length(word) <= 5, word).otherwise(F.regexp_replace(bare, rf"^(.{{{least},}}?)(?:{ends})$", "$1"))


def stem_of(word: str, endings: list[str] = L.ENDINGS, least: int = 4) -> str:
    """`stem` of one word on the driver, for constants."""
    if len(word) <= 5:
        return word
    word = re.sub(rf"^(.{{{least},}})(?:ся|сь)$", r"\1", word)
    return re.sub(rf"^(.{{{least},}}?)(?:{'|'.join(sorted(endings, key=len, reverse=True))})$", r"\1", word)


def tokens(text, stop: list[str] = L.STOP_WORDS) -> Column:
    """Tokens for retrieval: numbers and abbreviations as they are, stop words and single letters left out, the rest stemmed."""
    raw = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\d+(?:\.\d+)*\.?|[A-Za-zА-Яа-яЁё0-9]+"), F.lit(0))

    def one(t: Column) -> Column:
        low = lower_e(t)
        return (
            F.when(t.rlike(r"^\d+(?:\.\d+)*\.?$"), F.regexp_replace(t, r"\.$", ""))
            .when(t.rlike("^[A-ZА-ЯЁ][A-ZА-ЯЁ0-9]{1,7}$"), low)
            .when(low.isin(stop) | (F.length(low) < 2), F.lit(None))
            .otherwise(stem(low))
        )

    return F.filter(F.transform(raw, one), lambda t: t.isNotNull())


def stems5(text) -> Column:
    """First five letters of every word."""
    return F.transform(F.regexp_extract_all(lower_e(F.coalesce(_c(text), F.lit(""))), F.lit("[a-zа-я0-9]+(?:-[a-zа-я0-9]+)*"), F.lit(0)), lambda w: F.substring(w, 1, 5))


def rule_stem(word: Column) -> Column:
    """One ending off a word of more than three letters, then at most five letters."""
    cut = F.regexp_replace(word, r"(?:ами|ями|ов|ев|ей|ий|ый|ой|ая|яя|ое|ее|ые|ие|ых|их|ым|им|ую|юю|ого|его|ому|ему|ах|ях|ам|ям|ом|ем|а|я|о|е|и|ы|у|ю|ь|й)$", "")
    return F.substring(F.when((F.length(word) > 3) & (cut != ""), cut).otherwise(word), 1, 5)


def _markers(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def modality(text, prohibition=L.PROHIBITION, right=L.RIGHT, duty=L.DUTY) -> Column:
    """The marker that ends last decides; where several end there, prohibition before right before duty; null without marker."""
    t = fold(F.coalesce(_c(text), F.lit("")))
    everything = _markers([*prohibition, *right, *duty])
    upto = F.regexp_extract(t, rf"(?s)^(.*(?:^|{EDGE}){everything})(?:$|{EDGE})", 1)
    ends = lambda words: upto.rlike(rf"(?:^|{EDGE}){_markers(words)}$")
    return F.when(upto == "", F.lit(None)).when(ends(prohibition), "prohibition").when(ends(right), "right").when(ends(duty), "duty")


def lead_in_modality(text, **lexicon) -> Column:
    """As `modality`, but a prohibition anywhere wins."""
    hit = fold(F.coalesce(_c(text), F.lit(""))).rlike(rf"(?:^|{EDGE}){_markers(lexicon.get('prohibition', L.PROHIBITION))}(?:$|{EDGE})")
    return F.when(hit, F.lit("prohibition")).otherwise(modality(text, **lexicon))


def clause_modality(text, lead_in) -> Column:
    """A clause's own marker, else its lead-in's, else neutral."""
    return F.coalesce(modality(text), lead_in_modality(lead_in), F.lit("neutral"))


def strip_templates(text) -> Column:
    t = normalize_text(text)
    for p in L.TEMPLATE_PATTERNS:
        t = F.regexp_replace(t, rf"\b{p}", " ")
    return squeeze(t)


def is_template_for_retrieval(text) -> Column:
    """Fewer than two tokens are left once templates and general words are gone."""
    general = sorted({stem_of(w) for w in L.GENERIC_WORDS})
    return F.size(F.filter(tokens(strip_templates(text)), lambda t: ~t.isin(general))) < 2


def is_template_for_duplicates(text) -> Column:
    """A general turn of phrase, or fewer than three longer words once templates are gone."""
    t = norm(text)
    general = t.rlike(r"(?:^|[^\p{L}\p{N}_])(?:(?:ин|друг|проч)[\p{L}\p{N}_]+\s+(?:функци|обязанност|полномочи|поручени|задани)|поручени[\p{L}\p{N}_]*\s+руководств)")
    left = reduce(lambda x, p: F.replace(x, F.lit(p), F.lit(" ")), L.TEMPLATE_PHRASES, t)
    words = F.filter(F.regexp_extract_all(left, F.lit("[а-яa-z0-9-]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(L.STOP_WORDS))
    return general | (F.size(words) < 3)


def verb_head(text) -> Column:
    """Lower-case text without up to two auxiliary verbs."""
    t = F.trim(F.lower(_c(text)))
    for _ in range(2):
        t = F.regexp_replace(t, L.AUXILIARY, "")
    return t


def verb_class(text, classes=L.VERB_CLASSES, other: str = L.OTHER_CLASS) -> Column:
    """The first class whose stems begin the text after auxiliary verbs."""
    head = verb_head(text)
    out = None
    for name, stems in classes:
        hit = head.rlike(f"^(?:{stems})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def object_head(text, most: int = 6) -> Column:
    """The first words after the leading action, up to a separator, without stop words."""
    t = F.regexp_replace(verb_head(text), r"^[а-яёa-z]+(?:\s+(?:и|или)\s+[а-яёa-z]+)?\s+", "")
    words = F.regexp_extract_all(F.regexp_extract(t, r"(?s)^([^;:(,]*)", 1), F.lit("[а-яёa-z0-9-]+"), F.lit(0))
    keep = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(L.OBJECT_STOP) & ~w.rlike("^(?:" + "|".join(L.OBJECT_STOP_STEMS) + ")"))
    return F.concat_ws(" ", F.slice(keep, 1, most))


def signature(text) -> Column:
    """CLASS|object, a key for blocking."""
    return F.concat_ws("|", verb_class(text), object_head(text))


def usable_signature(sig) -> Column:
    """The signature if it has a class and an object, else null."""
    s = _c(sig)
    return F.when(s.rlike(r"(?s)^[^|]+\|.*\S"), s)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct members; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# -- clause numbers


def number_parent(number) -> Column:
    """'3.2.1' -> '3.2'; null for a first-level number."""
    n = _c(number)
    return F.when(n.contains("."), F.regexp_replace(n, r"\.[^.]*$", ""))


def number_ancestors(number) -> Column:
    """'3.2.1' -> ['3', '3.2']."""
    parts = F.split(_c(number), r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat_ws(".", F.slice(parts, 1, k)))).otherwise(F.array().cast("array<string>"))


def number_successors(number) -> Column:
    """Numbers that may follow: '3.9' -> ['4', '3.10', '3.9.1']."""
    parts = F.filter(F.split(_c(number), r"\."), lambda s: s.rlike(r"^\d+$"))
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.concat(F.slice(parts, 1, k - 1), F.array((F.element_at(parts, k).cast("int") + 1).cast("string")))))
    return F.when(F.size(parts) > 0, F.concat(up, F.array(F.concat(F.concat_ws(".", parts), F.lit(".1"))))).otherwise(F.array().cast("array<string>"))


def number_key(number) -> Column:
    """Printed number for lookups: lower case, Latin look-alikes as Russian letters, no final stop."""
    return F.translate(F.regexp_replace(F.lower(F.trim(_c(number))), r"\.+$", ""), L.NUMBER_LATIN, L.NUMBER_CYRILLIC)


# -- names of units


def unit_name_key(name) -> Column:
    """Lower case, no brackets and quotes, the kind of unit in its first case, no trailing 'общества' or 'компании'."""
    t = F.regexp_replace(lower_e(_c(name)), r"\([^)]*\)", " ")
    t = F.regexp_replace(squeeze(F.regexp_replace(t, '[«»"“”„]', "")), r"^[ .,;:–—-]+|[ .,;:–—-]+$", "")
    first = F.regexp_extract(t, r"^(\S*)", 1)
    lemma = None
    for base, (full, ends) in L.UNIT_KINDS.items():
        hit = first.rlike(f"^{base}(?:{'|'.join(ends)})$")
        lemma = F.when(hit, full) if lemma is None else lemma.when(hit, full)
    t = F.concat(lemma.otherwise(first), F.regexp_replace(t, r"^\S*", ""))
    return F.regexp_replace(t, "(?: (?:общества|компании))+$", "")


def abbreviation(name) -> Column:
    """The last '(ABBR)' of a name, or a name that is an abbreviation itself; else null."""
    token = r"[А-ЯЁA-Z][А-ЯЁA-Z0-9\-]{1,11}"
    inside = F.regexp_extract_all(_c(name), F.lit(rf"\((?:[Дд]алее\s*[-–—]?\s*)?({token})\)"), F.lit(1))
    bare = F.regexp_replace(_c(name), r"^[ .,;:]+|[ .,;:]+$", "")
    return F.when(F.size(inside) > 0, F.element_at(inside, -1)).when(bare.rlike(f"^{token}$"), bare)


def document_kind(name) -> Column:
    low = F.lower(_c(name))
    return F.when(low.contains("положение"), "polozhenie").when(low.contains("должностн"), "di").when(low.contains("приказ"), "order").otherwise("other")


# -- identifiers and labels


def text_sha256(text) -> Column:
    return F.sha2(_c(text), 256)


def content_id(*parts) -> Column:
    """First 12 hex digits of the SHA-1 of the parts, joined by a unit separator."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(_c(p), F.lit("")) for p in parts])), 1, 12)


def document_prefix(clause_id) -> Column:
    return F.substring_index(_c(clause_id), ":", 1)


def source_label(doc_name, version, number, quote) -> Column:
    return F.format_string("%s / %s / %s / %s", _c(doc_name), _c(version), F.coalesce(_c(number), F.lit("-")), _c(quote))


def safe_filename(name) -> Column:
    """Last path part, unsafe characters as _, at most the last 120 characters."""
    base = F.regexp_extract(_c(name), r"([^/\\]*)$", 1)
    return F.right(F.regexp_replace(base, r"[^\p{L}\p{N}._-]+", "_"), F.lit(120))


def redact_secrets(text) -> Column:
    """Keys and bearer tokens as ***."""
    return F.regexp_replace(_c(text), r"(?i)(sk-[a-z0-9_-]{8,}|bearer\s+[a-z0-9._-]{8,})", "***")


def timestamp_label(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- vectors


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a) -> Column:
    """Euclidean norm; 1 for a zero vector, so that it may divide."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)
