"""Filling containers of fixed capacity with texts measured in tokens: minimum bin slack.

Texts are counted once with a public tokenizer; from then on only (id, size) moves. A text larger than the
capacity is cut: its full pieces are packs of their own, its rest is an item like any other. Items are spread by
hash over shards of about SHARD_ITEMS, as many as the data needs, and each shard is packed by itself.

A pack starts with the largest size left. All sizes that still fit, largest first, go into
a subset-sum dynamic program over the multiset of sizes left: bit s of a big integer says that s can
be reached, a size with its count takes a few shifts, and the program stops once the remaining room is filled
exactly. The highest bit within the room is chosen and counts of each size are traced back.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseflow.session import Shelf

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of that family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ITEMS = 20_000
#: Kinds of container: a fixed, small list that the plan holds as constants.
MOST_KINDS = 1000

_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY, content: bytes | None = None):
    """The tokenizer of a vocabulary file, built once a process; content: the file's bytes where they are at hand."""
    if path not in _encoders:
        import tiktoken

        lines = (Path(path).read_bytes() if content is None else content).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row whose id and text aren't null; an empty text has 0. The driver reads the vocabulary (about 1 MB)."""
    content = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches):
        enc = encoder(vocabulary, content.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.fromiter((len(enc.encode_ordinary(t)) for t in pdf["text"]), np.int64, len(pdf))})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(run, "doc_id long, n_tokens long")


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The number of the pack of each item; sizes are at most the capacity, items of size 0 go to the first pack."""
    pack = np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    used = np.searchsorted(ordered, 0, side="right")
    lengths, first, counts = (x.tolist() for x in np.unique(ordered[used:], return_index=True, return_counts=True))
    at = {n: used + a for n, a in zip(lengths, first)}  # next item of each length
    left = dict(zip(lengths, counts))
    number = 0
    while lengths:
        take = {lengths[-1]: 1}
        room = capacity - lengths[-1]
        left[lengths[-1]] -= 1
        mask = (1 << (room + 1)) - 1
        reach, trail = 1, []
        hi = bisect_right(lengths, room)
        for n in reversed(lengths[:hi]):
            k = min(left[n], room // n)
            if not k:
                continue
            trail.append((n, k, reach))
            part = 1
            rest = k
            while rest:  # 1, 2, 4, ... copies, then what is left
                part = min(part, rest)
                reach |= reach << (n * part)
                rest -= part
                part *= 2
            reach &= mask
            if reach >> room:
                break
        best = reach.bit_length() - 1
        for n, k, before in reversed(trail):
            c = 0
            while not (before >> (best - c * n)) & 1:
                c += 1
            if c:
                take[n] = take.get(n, 0) + c
                left[n] -= c
                best -= c * n
        for n, c in take.items():
            pack[order[at[n] : at[n] + c]] = number
            at[n] += c
            if not left[n]:
                del left[n]
                lengths.pop(bisect_right(lengths, n) - 1)
        number += 1
    return pack


def _packer(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ignore_index=True)  # the result doesn't depend on the order of arrival
    number = fill(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
    kind, shard = pdf["container_kind"].iloc[0], pdf["shard"].iloc[0]
    return pdf[["container_kind", "doc_id", "piece", "first_token", "n_tokens"]].assign(pack_id=[f"{kind}-{shard}-{n}" for n in number])


def pack_texts(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_kind, pack_id, doc_id, piece, first_token, n_tokens): every text in packs of every kind of container.

    Only a text larger than the capacity has several pieces. Null ids, texts and capacities (and those below 1) are left out; a text
    of no tokens is put into the first pack of its shard; an id delivered twice with as many tokens counts once; other columns
    play no part; no documents or no containers give an empty result.
    """
    spark = documents.sparkSession
    sizes = Shelf(spark, "packing").put(token_counts(documents, vocabulary=vocabulary))
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).filter("container_kind IS NOT NULL AND capacity >= 1").distinct()
    each = [F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(map(tuple, kinds.limit(MOST_KINDS + 1).collect()))]
    if len(each) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    every = F.array(*each) if each else F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    shards = max(1, -(-sizes.count() // shard_items))
    pieces = (
        sizes.distinct()
        .select("doc_id", "n_tokens", F.inline(every))
        .withColumn("full", (F.col("n_tokens") / F.col("capacity")).cast("long"))
        .withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    )
    whole = pieces.filter("full > 0").select("container_kind", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select(
        "container_kind", F.format_string("%s-full-%d-%d", "container_kind", "doc_id", "piece").alias("pack_id"), "doc_id", "piece",
        (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"),
    )
    rest = pieces.filter("rest > 0 OR n_tokens = 0").select(
        "container_kind", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id",
        F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("first_token"), F.col("rest").alias("n_tokens"),
    )
    packed = rest.groupBy("container_kind", "shard").applyInPandas(_packer, "container_kind string, doc_id long, piece long, first_token long, n_tokens long, pack_id string")
    return whole.unionByName(packed).select("container_kind", "pack_id", "doc_id", "piece", "first_token", "n_tokens")


def pack_fill(packs: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, packs, tokens, least_packs, filled): how full the packs of each kind are."""
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    each = packs.groupBy("container_kind", "pack_id").agg(F.sum("n_tokens").alias("t")).groupBy("container_kind").agg(F.count("*").alias("packs"), F.sum("t").alias("tokens"))
    return each.join(F.broadcast(kinds), "container_kind").select(
        "container_kind", "packs", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_packs"), F.round(F.col("tokens") / (F.col("packs") * F.col("capacity")), 4).alias("filled")
    )
