"""One form for text that looks the same: width, composition, look-alikes, invisible characters, blanks.

A quick check finds the segments that the form may change. It rests on Unicode's normalization properties, read from the character
database: a character is unstable if it isn't its own form (NFC quick check "no", invisible, wide, a blank of another kind, a
look-alike), or may join the one before it ("maybe": it stands second in a composition, or is a combining mark). Only those segments,
each with the one character before it that a mark could join, are rewritten; the rest of the text is spliced back as it was.

`canonicalize` translates texts in which single letters are the only thing to change (all plain English ones) inside the JVM. Of quotes,
only those not contained as written go to Python.

Case, ё and е, and everything else that is seen, stay different.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin and Greek letters and the Cyrillic letters that look the same.
LOOKALIKE = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У",
    "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у",
    "Α": "А", "Β": "В", "Ε": "Е", "Η": "Н", "Ι": "І", "Κ": "К", "Μ": "М", "Ν": "N", "Ο": "О", "Ρ": "Р", "Τ": "Т", "Υ": "У", "Χ": "Х", "Ζ": "Z", "ο": "о", "ν": "v",
    "Ү": "У", "Һ": "Н", "ԛ": "q", "ԝ": "w", "ԁ": "d", "һ": "h", "Ԛ": "Q", "Ԝ": "W",
    # hyphens: hyphen, non-breaking hyphen, hyphen bullet, modifier minus, minus sign, small hyphen-minus
    "‐": "-", "‑": "-", "⁃": "-", "˗": "-", "−": "-", "﹣": "-",
}
_LETTERS = str.maketrans(LOOKALIKE)
# Letters and marks without a shape.
INVISIBLE = "\u115f\u1160\u3164\u034f"

def _one(ch: str) -> str:
    """One character without composition: invisible ones vanish, blanks and widths become one kind."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or ch in INVISIBLE:
        return ""
    if kind == "Zs":
        return " "
    how = unicodedata.decomposition(ch)
    if how.startswith(("<wide>", "<narrow>")):
        return "".join(_one(chr(int(x, 16))) for x in how.split()[1:])
    return ch


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = _one(chr(code))
        return out


_FOLD = _Fold()


def _rewrite(segment: str) -> str:
    apart = unicodedata.normalize("NFD", segment.translate(_FOLD))
    return unicodedata.normalize("NFC", apart.translate(_LETTERS))


#: Code points in which characters may be unstable; the rest are ideographs, Hangul syllables and private ones.
_RANGES = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))


def unstable_ranges() -> list[tuple[int, int]]:
    """First and last code points of the runs of unstable characters."""
    joins: set[int] = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # Hangul vowels and finals
    odd: set[int] = set()
    for a, b in _RANGES:
        for code in range(a, b):
            ch = chr(code)
            how = unicodedata.decomposition(ch)
            parts = how.split()
            if len(parts) == 2 and how[0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                joins.add(int(parts[1], 16))
            if how or ch in LOOKALIKE or unicodedata.combining(ch) or unicodedata.category(ch) in ("Cf", "Zs") or ch in INVISIBLE or 0xFE00 <= code <= 0xFE0F:
                if unicodedata.combining(ch) or _rewrite(ch) != ch:
                    odd.add(code)
    runs: list[list[int]] = []
    for code in sorted(odd | joins):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return [tuple(r) for r in runs]


UNSTABLE = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in unstable_ranges()) + "]"
_SEGMENT = re.compile(f"(?s).?{UNSTABLE}+")
#: The quick check inside the JVM: anything but letters and signs that stand alone and change as single ones or not at all.
_ODD = r"[^\t\n\r -~А-яЁёІіЈјЅѕ«»№–—•…„“”‐‑−]"
_FROM, _TO = "".join(c for c in LOOKALIKE if not re.match(_ODD, c)), "".join(v for c, v in LOOKALIKE.items() if not re.match(_ODD, c))


def canonical_text(text: str | None) -> str | None:
    """The one form of a text; null stays null, a text of invisible characters becomes empty."""
    if text is None:
        return None
    return _SEGMENT.sub(lambda m: _rewrite(m.group()), text)


def canonical_whole(text: str | None) -> str | None:
    """The same form made the plain way, from the whole text; the segments are tested against it."""
    return None if text is None else _rewrite(text)


@F.pandas_udf(T.StringType())
def _canonical(text: pd.Series) -> pd.Series:
    return text.map(canonical_text, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _looks_contained(quote: pd.Series, text: pd.Series) -> pd.Series:
    # pairs come sorted by clause: each clause is brought to its form once, not once a citation
    known, form, out = None, "", []
    for q, t in zip(quote, text):
        if t != known:
            known, form = t, canonical_text(t)
        out.append(canonical_text(q) in form)
    return pd.Series(out, dtype="boolean")


def _letters(text) -> Column:
    return F.translate(text, _FROM, _TO)


def _odd(text) -> Column:
    return F.coalesce(text.rlike(_ODD), F.lit(False))


def canonicalize(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """df with `out_col`, the one form of `text_col`; other columns stay.

    Null gives null, empty gives empty. Only texts with other than single letters to change go to Python.
    """
    text = F.col(text_col)
    return df.filter(~_odd(text)).withColumn(out_col, _letters(text)).unionByName(df.filter(_odd(text)).withColumn(out_col, _canonical(text)))


def lookalike_quotes(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """(citation_id): quotes not contained as written in their clause's text, but contained once both have one form.

    citations: citation_id, clause_id, quote; clauses: id, text. Null quotes, ids or texts and dangling ids give no row;
    repeated rows count once; an id with several texts gives a row if one of them makes it a case; an empty quote is
    contained in any text as written; other columns play no part.
    """
    c = citations.select("citation_id", F.col("clause_id").alias("id"), "quote").filter("quote IS NOT NULL AND id IS NOT NULL")
    t = clauses.select("id", "text").filter("id IS NOT NULL AND text IS NOT NULL")

    # most quotes are contained as written: only the rest of the pairs are looked at
    both = c.join(t, "id").filter(~F.contains("text", "quote"))
    return both.filter(_looks_contained("quote", "text")).select("citation_id").distinct()
