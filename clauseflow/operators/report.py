"""Report assembly: statistics, numbered findings, facets, Markdown rows, payload keys."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clauseflow.session import Shelf

REQUIRED_STATS = ["units_before", "units_after", "functions_before", "functions_after", "matches", "lost", "new", "duplicates", "conflicts", "unverified_candidates"]


def stats_rows(parts: dict[str, DataFrame], required: list[str] = REQUIRED_STATS) -> DataFrame:
    """(stat, value): one row per required key, 0 where no part counts it. parts: name -> one-row frame with a column n."""
    spark = next(iter(parts.values())).sparkSession
    have = None
    for name, df in parts.items():
        x = df.select(F.lit(name).alias("stat"), F.col("n").cast("long").alias("value"))
        have = x if have is None else have.unionByName(x)
    keys = spark.createDataFrame([(k,) for k in required], "stat string")
    return keys.join(have, "stat", "left").select("stat", F.coalesce("value", F.lit(0)).alias("value"))


def numbered(findings: DataFrame, categories: list[str], order: list[str], prefix: str = "F") -> DataFrame:
    """Findings numbered F1, F2, ... by category in the given order, then by `order`.

    Rows are spread by ranges of (category, order) and written; numbers follow from the counts of ranges and places within one, so no
    task orders all rows, not even those of one category.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    rows = findings.withColumn("_c", place).filter("_c > 0").repartitionByRange("_c", *order).withColumn("_p", F.spark_partition_id())
    rows = Shelf(findings.sparkSession, "numbered").put(rows)
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_c", *order))
    return rows.join(F.broadcast(ahead), "_p").withColumn("ref", F.concat(F.lit(prefix), (F.col("_ahead") + within).cast("string"))).drop("_c", "_p", "_ahead")  # one row a range


def markdown_cell(c: Column) -> Column:
    """A table cell: bars escaped, line ends as blanks, null as a dash."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " "))
    return F.when(t == "", "—").otherwise(t)


def markdown_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, line): each row as a line of a Markdown table."""
    return df.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in columns]), F.lit(" |")).alias("line"))


def markdown_document(sections: list[tuple[str, list[str], DataFrame]]) -> str:
    """A Markdown text of report-sized tables: [(title, headings, frame of lines with a column `line`)]. The lines come to the driver."""
    out = []
    for title, heads, lines in sections:
        body = [r["line"] for r in lines.select("line").collect()]
        out.append(f"## {title}\n")
        out.append("\n".join(["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *body]) if body else "—")
    return "\n\n".join(out) + "\n"


def payload_key(payload: dict) -> str:
    """First 16 hex digits of the SHA-256 of the payload as JSON with sorted keys: the name under which an answer is stored."""
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


def with_payload_key(df: DataFrame, fields: list[str], out: str = "payload_key") -> DataFrame:
    """df with the key of the payload made of `fields`; null stays null in the payload."""

    @F.pandas_udf(S.StringType())
    def key(rows: pd.DataFrame) -> pd.Series:
        clean = rows.astype(object).where(rows.notna(), None)
        return pd.Series([payload_key(r) for r in clean.to_dict("records")], dtype="object")

    return df.withColumn(out, key(F.struct(*fields)))


# How references to clauses are written, and words that only lead to one.
_REFERENCE = re.compile(r"\b(?:пп?\.|пункт[а-я]*|подпункт[а-я]*)\s*(?P<a>[1-9]\d?(?:\.\d+)*(?:\.[а-я](?![а-я]))?)\.?|(?<![\w.])(?P<b>[1-9]\d?(?:\.\d+)+(?:\.[а-я](?![а-я]))?)(?!\d)", re.I)
_LEADING = re.compile(r"(?:(?<!\w)(?:см|ср)\.?|(?<!\w)также|(?<!\w)и|[,;])\s*$", re.I)


def clause_number_key(number: str) -> str:
    return number.strip().rstrip(".").lower()


def scrub_references(text: str, allowed: set[str]) -> tuple[str, list[str]]:
    """The text without references to clauses that are not allowed, and the numbers that went.

    The spans of these references are cut out; where two pieces meet, what only led to the reference goes too: brackets that are empty
    now, and a conjunction or comma that nothing follows.
    """
    spans = [(m.start(), m.end(), clause_number_key(m.group("a") or m.group("b"))) for m in _REFERENCE.finditer(text)]
    spans = [s for s in spans if s[2] not in allowed]
    if not spans:
        return text, []
    left = text[: spans[0][0]]
    for k, (_, end, _) in enumerate(spans):
        right = text[end : spans[k + 1][0] if k + 1 < len(spans) else len(text)]
        last = k + 1 == len(spans)
        left, right = left.rstrip(), right.lstrip()
        if right[:1] in (".", ";", ")") or (not right and last):
            bare = left
            while (m := _LEADING.search(bare)) and (right[:1] == ")" or m.group()[0].lower() in "и,"):
                bare = bare[: m.start()].rstrip()
            if right[:1] == ")" and bare.endswith("("):
                left, right = bare[:-1].rstrip(), right[1:].lstrip()
            elif right[:1] and not bare.endswith("("):
                left = bare
        glue = "" if not left or not right or right[0] in ",.;:)" or left.endswith("(") else " "
        left += glue + right
    return re.sub(r"\s{2,}", " ", left).strip(), [n for *_, n in spans]


@F.pandas_udf(S.StructType([S.StructField("text", S.StringType()), S.StructField("removed", S.ArrayType(S.StringType()))]))
def scrubbed(text: pd.Series, allowed: pd.Series) -> pd.DataFrame:
    rows = [(None, []) if t is None else scrub_references(t, {clause_number_key(str(x)) for x in (() if a is None else a) if x is not None}) for t, a in zip(text, allowed)]
    return pd.DataFrame(rows, columns=["text", "removed"])
