"""Ranked retrieval: inverted index with BM25 weights, vectors, signatures, and their fusion by reciprocal rank.

The index is a table of postings (term, id, weight). A query's terms join it on the term and weights are summed by
(query, id) with partial sums before the shuffle; hot terms are split by adaptive execution. Ranks are windows by query with a
limit, which Spark prunes before the shuffle (WindowGroupLimit). Ties are broken by id.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow.functions import text as T
from clauseflow.session import Shelf

K1, B = 1.5, 0.75
TOP_K, POOL, RRF_K = 5, 20, 60
CORPUS_BLOCK, QUERY_BLOCK = 50_000, 50_000
LEAST_BLOCK = 2_000


def term_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf, length): docs without tokens have no row."""
    t = docs.select(F.col(id_col).alias("id"), tokens.alias("t")).filter("id IS NOT NULL").select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return t.groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def bm25_index(docs: DataFrame, id_col: str, tokens: Column, k1: float = K1, b: float = B) -> DataFrame:
    """Postings (term, id, weight). Documents without tokens count in the number of documents and the mean length.

    Texts are read and cut into tokens once; counts by document and term are written and used for all statistics.
    """
    n = docs.filter(F.col(id_col).isNotNull()).count()
    counts = Shelf(docs.sparkSession, "bm25").put(term_counts(docs, id_col, tokens))
    total = counts.agg(F.sum("tf")).first()[0] or 0
    mean = total / n if total else 1.0
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    weight = idf * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(float(mean)))))
    return counts.join(df, "term").select("term", "id", weight.alias("weight"))


def bm25_scores(queries: DataFrame, query_id: str, tokens: Column, index: DataFrame) -> DataFrame:
    """(query, id, score): sums over the distinct terms of a query; only pairs with a common term."""
    terms = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(tokens)).alias("term")).filter("query IS NOT NULL").distinct()
    return terms.join(index, "term").groupBy("query", "id").agg(F.round(F.sum("weight"), 9).alias("score"))


def top(scores: DataFrame, k: int, order: list[Column], by: str = "query") -> DataFrame:
    """scores with `rank`, the first k of each query."""
    w = Window.partitionBy(by).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_top(queries: DataFrame, query_id: str, query_tokens: Column, index: DataFrame, k: int = TOP_K) -> DataFrame:
    scores = bm25_scores(queries, query_id, query_tokens, index).filter("score > 0")
    return top(scores, k, [F.desc("score"), F.asc("id")])


def cosine_top(queries: DataFrame, corpus: DataFrame, k: int = POOL, blocks: int | None = None) -> DataFrame:
    """(query, id, cosine, rank): a stated set of query vectors against all rows, both (id, vector).

    The corpus falls into blocks, by default of about CORPUS_BLOCK rows and at least as many as shuffles have parts; each block meets all queries: no
    task holds all rows, and what leaves a block is its own first k of each query. Vectors of another dimension match nothing.
    """
    if blocks is None:
        blocks = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // CORPUS_BLOCK))
    q = queries.select(F.col("id").alias("query"), F.col("vector").alias("qv"), T.l2("vector").alias("qn"), F.size("vector").alias("dim")).filter("query IS NOT NULL AND qv IS NOT NULL")
    q = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    c = corpus.select("id", "vector", T.l2("vector").alias("n"), F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).filter("id IS NOT NULL AND vector IS NOT NULL")
    pairs = c.join(q, ["block", "dim"]).filter("id <> query")
    scored = pairs.select("query", "block", "id", F.round(T.dot("qv", "vector") / (F.col("qn") * F.col("n")), 9).alias("cosine"))
    order = [F.desc("cosine"), F.asc("id")]
    w = Window.partitionBy("query", "block").orderBy(*order)
    first = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r", "block")
    return top(first, k, order)


def fuse(pools: dict[str, DataFrame], exact: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """(query, id, score, reasons, rank): exact matches first with score +inf, then the sum of 1/(rrf_k + rank) over the pools."""
    parts = None
    for name, pool in pools.items():
        x = pool.select("query", "id", F.lit(name).alias("pool"), (1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("part"))
        parts = x if parts is None else parts.unionByName(x)
    order = F.array(*[F.lit(n) for n in pools])
    fused = parts.groupBy("query", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.collect_set("pool").alias("hit"))
    fused = fused.select("query", "id", "score", F.array_join(F.array_intersect(order, "hit"), ",").alias("reasons"))
    exact = exact.select("query", "id", F.lit(float("inf")).alias("score"), F.lit("exact").alias("reasons"))
    ranked = top(fused.unionByName(exact), k, [F.desc("score"), F.asc("id")])
    return ranked.select("query", "id", F.round("score", 6).alias("score"), "reasons", "rank")


def rank_candidates(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, pool: int = POOL, other_unit: bool = False) -> DataFrame:
    """Hybrid candidates of each query row: exact, lexical (BM25) and signature pools, fused.

    queries and corpus: id, text, signature, unit_id and, where both have it, vector: then the nearest by cosine are a third pool; rows without
    a vector, or of another dimension, aren't in it. other_unit: only rows of another, known unit are candidates, and never the row itself.
    Returns (query, id, score, reasons, rank).
    """
    shelf = Shelf(corpus.sparkSession, "candidates")

    def prepared(df: DataFrame) -> DataFrame:  # each text is normalised and cut into tokens once
        return shelf.put(df.select("id", F.col("unit_id").alias("unit"), T.normalize_text("text").alias("key"), T.usable_signature("signature").alias("sig"), T.tokens("text").alias("t")).filter("id IS NOT NULL"))

    c, q = prepared(corpus), prepared(queries).withColumnsRenamed({"id": "query", "unit": "query_unit"})
    pair = ["query", "id"]

    def allowed(x: DataFrame) -> DataFrame:
        return x.filter("query_unit <> unit AND query <> id") if other_unit else x

    exact = allowed(q.filter("key <> ''").select("query", "query_unit", "key").join(c.select("id", "unit", "key"), "key")).select(*pair)
    index = bm25_index(c, "id", F.col("t"))
    if other_unit:
        index = index.join(c.select("id", "unit"), "id")
    terms = q.select("query", "query_unit", F.explode(F.array_distinct("t")).alias("term"))
    scores = shelf.put(allowed(terms.join(index, "term")).groupBy(*pair).agg(F.round(F.sum("weight"), 9).alias("score")))
    rest = scores.join(exact, pair, "left_anti")
    lexical = top(rest.filter("score > 0"), pool, [F.desc("score"), F.asc("id")])
    same = allowed(q.select("query", "query_unit", "sig").join(c.select("id", "unit", "sig"), "sig")).select(*pair).join(exact, pair, "left_anti")
    same = same.join(rest, pair, "left").select(*pair, F.coalesce("score", F.lit(0.0)).alias("score"))
    signature = top(same, pool, [F.desc("score"), F.asc("id")])
    pools = {"lexical": lexical, "signature": signature}
    if "vector" in queries.columns and "vector" in corpus.columns:
        pools["dense"] = dense_pool(queries, corpus, exact, pool, other_unit)
    return fuse(pools, exact, k)


def dense_pool(queries: DataFrame, corpus: DataFrame, exact: DataFrame, pool: int = POOL, other_unit: bool = False) -> DataFrame:
    """(query, id, cosine, rank): the nearest rows of each query by cosine, without exact matches."""
    if not other_unit:
        # exact matches take places that then fall free: so many more are looked at
        most = exact.groupBy("query").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        found = cosine_top(queries.select("id", "vector"), corpus.select("id", "vector"), pool + most).drop("rank")
        return top(found.join(exact, ["query", "id"], "left_anti"), pool, [F.desc("cosine"), F.asc("id")])
    units = corpus.select("id", F.col("unit_id").alias("unit")).dropna().distinct()
    of = queries.select(F.col("id").alias("query"), F.col("unit_id").alias("query_unit")).dropna().distinct()
    own = units.groupBy("unit").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # rows of the own unit fall out behind the search
    found = cosine_top(queries.select("id", "vector"), corpus.join(units.select("id"), "id", "left_semi").select("id", "vector"), pool + own).drop("rank")
    found = found.join(of, "query").join(units, "id").filter("query_unit <> unit").join(exact, ["query", "id"], "left_anti")
    return top(found.select("query", "id", "cosine"), pool, [F.desc("cosine"), F.asc("id")])


def _block_pools(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, pool: int, other_unit: bool) -> pd.DataFrame:
    """(query, id, pool, score): what one block of the corpus may add to the pools of one block of queries."""
    none = pd.DataFrame({"query": [], "id": [], "pool": [], "score": []})
    if not len(queries) or not len(corpus):
        return none
    corpus = corpus.sort_values("id", kind="stable", ignore_index=True)  # places stand in order of id
    n, ids = len(corpus), corpus["id"].to_numpy()
    sizes = corpus["terms"].map(len).to_numpy()
    terms = np.concatenate([*corpus["terms"], np.empty(0)]).astype(np.int64)
    order = np.argsort(terms, kind="stable")
    docs, weights = np.repeat(np.arange(n), sizes)[order], np.concatenate([*corpus["weights"], np.empty(0)])[order]
    known, first, count = np.unique(terms[order], return_index=True, return_counts=True)
    lists = {t: (docs[i : i + m], weights[i : i + m]) for t, i, m in zip(known.tolist(), first.tolist(), count.tolist(), strict=True)}
    units = corpus["unit"].to_numpy()
    of_unit, of_key, of_sig = ({v: np.asarray(at) for v, at in corpus.groupby(c).indices.items()} for c in ("unit", "key", "sig"))
    nothing = np.empty(0, dtype=np.int64)
    without_unit = np.flatnonzero(pd.isna(units))
    place_of = {i: np.asarray(at) for i, at in corpus.groupby("id").indices.items()} if other_unit else {}
    parts = []
    for query, unit, key, sig, mates, words in zip(*(queries[c] for c in ("query", "query_unit", "key", "sig", "mates", "terms")), strict=True):
        if other_unit and pd.isna(unit):
            continue
        hits = [lists[t] for t in words.tolist() if t in lists]
        score = np.bincount(np.concatenate([d for d, _ in hits]), np.concatenate([w for _, w in hits]), n) if hits else np.zeros(n)
        exact, same = of_key.get(key, nothing), of_sig.get(sig, nothing)
        if other_unit:
            own = of_unit.get(unit, nothing)
            score[own] = score[without_unit] = -1.0
            score[place_of.get(query, nothing)] = -1.0
            exact, same = exact[score[exact] >= 0], same[score[same] >= 0]
        score[exact] = -1.0
        most = pool if mates else min(k, pool)  # without a signature pool, ranks beyond k can't reach the first k
        least = max(np.partition(score, n - most)[n - most] - 2e-9, 0.0) if n > most else 0.0
        found = np.flatnonzero(score > least) if least == 0.0 else np.flatnonzero(score >= least)
        value = np.round(score[found], 9)
        found, value = found[value > 0], value[value > 0]
        best = np.lexsort((found, -value))[:most]
        same = same[score[same] >= 0]
        same_value = np.round(score[same], 9)
        same_best = np.lexsort((same, -same_value))[:pool]
        for name, at, v in (("exact", exact[:pool], np.zeros(len(exact[:pool]))), ("lexical", found[best], value[best]), ("signature", same[same_best], same_value[same_best])):
            if len(at):
                parts.append((query, name, at, v))
    if not parts:
        return none
    m = [len(x[2]) for x in parts]
    return pd.DataFrame({"query": np.repeat([x[0] for x in parts], m), "id": ids[np.concatenate([x[2] for x in parts])], "pool": np.repeat([x[1] for x in parts], m), "score": np.concatenate([x[3] for x in parts])})


def rank_all(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, pool: int = POOL, other_unit: bool = False) -> DataFrame:
    """`rank_candidates` with the same result, for queries that are as many as the corpus.

    Almost every pair has a common term there, so pairs are never rows: blocks of queries meet blocks of the corpus in a Python worker,
    where scores are sums into an array, and only a block's first `pool` of each query leave it (the first k, if nothing shares its signature). No task holds all rows.
    """
    spark = corpus.sparkSession
    shelf = Shelf(spark, "rank-all")

    def prepared(df: DataFrame) -> DataFrame:
        key = T.normalize_text("text")
        sig = T.usable_signature("signature")
        return shelf.put(df.select("id", F.col("unit_id").alias("unit"), F.when(key != "", F.md5(key)).alias("key"), F.md5(sig).alias("sig"), T.tokens("text").alias("t")).filter("id IS NOT NULL"))

    c, q = prepared(corpus), prepared(queries)
    index = shelf.put(bm25_index(c, "id", F.col("t")))
    words = shelf.put(index.select("term").distinct().withColumn("n", F.monotonically_increasing_id()))  # a number for each term, fixed by writing it
    postings = index.join(words, "term").groupBy("id").agg(F.collect_list(F.struct("n", "weight")).alias("p"))
    asked = q.select("id", F.explode(F.array_distinct("t")).alias("term")).join(words, "term").groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("terms"))
    of_sig = c.filter("sig IS NOT NULL" + " AND unit IS NOT NULL" * other_unit).groupBy("sig").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    mates = (F.col("low") != F.col("unit")) | (F.col("high") != F.col("unit")) if other_unit else F.lit(True)
    q_sig = q.join(of_sig.withColumn("any", F.lit(True)), "sig", "left").withColumn("mates", F.coalesce(F.col("any") & mates, F.lit(False)))
    n_corpus, n_queries = c.count(), q.count()
    wide, cores = max(1, -(-n_queries // QUERY_BLOCK)), spark.sparkContext.defaultParallelism
    # at least a block a core where the corpus has some thousand rows for each; rows of queries are copied once a block of the corpus
    high = max(1, -(-n_corpus // CORPUS_BLOCK), min(-(-cores // wide), n_corpus // LEAST_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    longs, doubles = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    left = c.drop("t").join(postings, "id", "left").select("id", "unit", "key", "sig", F.coalesce("p.n", longs).alias("terms"), F.coalesce("p.weight", doubles).alias("weights"), block(high).alias("cb"), all_blocks(wide).alias("qb"))
    right = q_sig.join(asked, "id", "left").select(F.col("id").alias("query"), F.col("unit").alias("query_unit"), "key", "sig", "mates", F.coalesce("terms", longs).alias("terms"), block(wide).alias("qb"), all_blocks(high).alias("cb"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * high * wide)
    left, right = left.repartition(parts, "cb", "qb"), right.repartition(parts, "cb", "qb")
    pools = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(lambda x, y: _block_pools(y, x, k, pool, other_unit), "query string, id string, pool string, score double")
    pools = shelf.put(pools)
    shelf.drop(c, q, index, words)  # what follows reads the pools only
    del left, right
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffle files go once the driver has no plan left that reads them
    ranked = {n: top(pools.filter(F.col("pool") == n).drop("pool"), pool, [F.desc("score"), F.asc("id")]) for n in ("lexical", "signature")}
    return fuse(ranked, pools.filter("pool = 'exact'"), k)


def augment(forward: DataFrame, reverse: DataFrame, k: int = TOP_K) -> DataFrame:
    """Forward candidates with each corpus row added to its top query: exact first, then added, then the rest, at most k.

    forward: (query, id, score, reasons, rank); reverse: the same with the roles of query and id swapped.
    """
    added = reverse.filter("rank = 1").select(F.col("id").alias("query"), F.col("query").alias("id"), F.lit(True).alias("added"))
    both = forward.select("query", "id", "rank", (F.col("reasons") == "exact").alias("exact")).join(added, ["query", "id"], "full")
    kind = F.when(F.coalesce("exact", F.lit(False)), 0).when(F.coalesce("added", F.lit(False)), 1).otherwise(2)
    ordered = both.select("query", "id", kind.alias("kind"), F.coalesce("rank", F.lit(1 << 30)).alias("forward_rank"))
    return top(ordered, k, [F.asc("kind"), F.asc("forward_rank"), F.asc("id")]).select("query", "id", "kind", "rank")
