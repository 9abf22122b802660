"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard.

A text is reduced to its distinct character n-grams, each placed by a first permutation in one of 2**16 slots (2**22 for texts of
so many grams that they would fill them). The second permutation is one fixed table; coordinate k of the signature is the
minimum over the text's slots of that table shifted circularly by k. All coordinates of an n-gram
are thus one contiguous slice of the table, and a signature is the running minimum of such slices.

Bands of `rows` coordinates are hashed. What moves between executors is, for each batch of texts
and bucket of hashes, one packed block: the keys and one-bit sketches of its texts once, then their
hashes. Within a bucket, texts that share a band are compared by their sketches, and only pairs
that may reach the limit leave it; those are verified on the whole texts by exact Jaccard. Equal
texts share a key of 96 bits and count once throughout, however many rows have them.

A band that very many different texts share (a boilerplate) would make one bucket quadratic. A bounded sample shows which values
these are; their texts travel in blocks of their own, and every two blocks are compared in a task of their own. The
sample decides only where texts are compared, never whether.

With many buckets a text would travel with almost every one of its bands. Beyond ROUND_TEXTS texts, keys, sketches and hashes are therefore
written once, and a few bands travel at a time; what a round has shuffled is deleted before the next. A bucket then holds a bounded number of texts.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseflow.operators.graph import propagate_min
from clauseflow.session import Shelf

#: Slots of ordinary and of long texts, in bits. A text is long from LONG distinct slots on; near that size it is signed both ways,
#: since a pair may lie on both sides.
SLOT_BITS = (16, 22)
LONG = 8192
SEED = 20240607
#: A band value shared by more texts than this is compared block by block; found from a sample of so many texts.
HEAVY = 16_384
SAMPLE = 8_000
#: Records of bands that one bucket holds on average; the number of buckets follows the number of rows.
BUCKET_RECORDS = 3_000_000
#: Bits of a band's hash that are kept inside a bucket; a chance agreement costs one comparison.
HASH_BITS = 24
#: Up to so many texts all bands travel at once, beyond it ROUND_BANDS at a time.
ROUND_TEXTS = 400_000
ROUND_BANDS = 5
#: Texts that one bucket of a round holds on average, some 20 MB; texts of a block of a heavy value.
BUCKET_TEXTS = 400_000
HEAVY_BLOCK = 8_192
#: Stands for the hash of a band whose value is heavy.
GONE = 0xFFFFFFFF


@dataclass(frozen=True)
class Plan:
    """bands x rows coordinates; a pair at similarity s shares a band with probability 1-(1-s**rows)**bands."""

    n: int = 4
    bands: int = 60
    rows: int = 5
    limit: float = 0.6
    sketch_words: int = 4  # of 64 one-bit coordinates
    slack: float = 4.0  # standard deviations that a sketch may fall below the limit

    @property
    def coords(self) -> int:
        return max(self.bands * self.rows, 64 * self.sketch_words)

    @property
    def most_apart(self) -> int:
        """Sketch bits in which a pair at the limit may differ."""
        bits = 64 * self.sketch_words
        p = (1 + self.limit) / 2
        return int(bits * (1 - p) + self.slack * (bits * p * (1 - p)) ** 0.5) + 1


def normalized(text):
    """Lower case, ё as е, runs of other characters than letters and digits as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]+", " "))


@lru_cache(maxsize=4)
def _table(coords: int, bits: int) -> np.ndarray:
    pi = np.random.default_rng(SEED).permutation(1 << bits).astype(np.uint16 if bits <= 16 else np.uint32)
    return np.concatenate([pi, pi[:coords]])


def _hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of all texts one after another, and how many each text has (at least 1)."""
    texts = [t if len(t) >= n else t.ljust(n, "\0") for t in texts]  # a short text is its own only gram
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(len(code) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum(lens)
    keep = np.ones(len(h), bool)
    for i in range(1, n):  # grams that would run over the end of a text
        at = ends[:-1] - i
        keep[at[at < len(h)]] = False
    return h[keep], lens - n + 1


def _signed(h: np.ndarray, counts: np.ndarray, coords: int, bits: int) -> np.ndarray:
    slots = (h >> np.uint64(64 - bits)).astype(np.int64)
    view = np.lib.stride_tricks.sliding_window_view(_table(coords, bits), coords)
    starts = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    out = np.empty((len(counts), coords), np.uint32)
    step = 128
    for a in range(0, len(order), step):  # texts of like length side by side, gram by gram
        rows = order[a : a + step]
        at, k = starts[rows], counts[rows]
        sig = view[slots[at]]
        for j in range(1, int(k[-1])):
            live = int(np.searchsorted(k, j, side="right"))  # rows[live:] have a j-th gram
            np.minimum(sig[live:], view[slots[at[live:] + j]], out=sig[live:])
        out[rows] = sig
    return out


def signatures(texts: list[str], plan: Plan) -> np.ndarray:
    """(texts, coords): the ordinary signatures."""
    return _signed(*_hashes(texts, plan.n), plan.coords, SLOT_BITS[0])


def _all_signatures(texts: list[str], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, long, coordinates) of each signature: one of every text, two of those whose size is near LONG."""
    h, counts = _hashes(texts, plan.n)
    ends = np.cumsum(counts)
    size = counts.copy()
    for i in np.flatnonzero(counts > LONG * plan.limit):  # only then may the distinct ones be as many
        size[i] = len(np.unique(h[ends[i] - counts[i] : ends[i]] >> np.uint64(64 - SLOT_BITS[1])))
    small, large = np.flatnonzero(size < LONG), np.flatnonzero(size >= LONG * plan.limit * 0.9)
    out = []
    for which, bits in ((small, SLOT_BITS[0]), (large, SLOT_BITS[1])):
        if len(which):
            part = h if len(which) == len(texts) else np.concatenate([h[ends[i] - counts[i] : ends[i]] for i in which])
            out.append((which, np.full(len(which), bits != SLOT_BITS[0]), _signed(part, counts[which], plan.coords, bits)))
    return tuple(map(np.concatenate, zip(*out)))


def _bands(sig: np.ndarray, long: np.ndarray, plan: Plan) -> np.ndarray:
    """(signatures, bands) of 64-bit hashes, different for each band and kind of signature."""
    x = sig[:, : plan.bands * plan.rows].reshape(len(sig), plan.bands, plan.rows).astype(np.uint64)
    h = (np.arange(1, plan.bands + 1, dtype=np.uint64)[None, :] + long.astype(np.uint64)[:, None] * np.uint64(1 << 20)) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(plan.rows):
        h = (h ^ x[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


def _sketch(sig: np.ndarray, plan: Plan) -> np.ndarray:
    bits = np.packbits((sig[:, : 64 * plan.sketch_words] & 1).astype(np.uint8), axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting machine words is faster than hashing them."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


_KEY = np.dtype([("k1", "<i8"), ("k2", "<i4")])


def _first_of(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The place of one row of each distinct key, in the order of keys."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    return order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(order) else order


def _even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """Numbers that hash partitioning over n parts puts into parts 0, 1, ..., n - 1: a task a bucket, none with two or three."""
    if n == 1:
        return np.zeros(1, np.int64)
    room = 16 * n
    while True:
        k = F.col("id").cast("int")
        found = spark.range(room).groupBy(F.pmod(F.hash(k), F.lit(n)).alias("part")).agg(F.min(k).alias("k")).collect()
        if len(found) == n:
            return np.array([r["k"] for r in sorted(found, key=lambda r: r["part"])], np.int64)
        room *= 4


def _by_bucket(key: np.ndarray, sketch: np.ndarray, high: np.ndarray, low: np.ndarray, row: np.ndarray, buckets: int):
    """(bucket, block) of the bands of some texts: `high`, of 32 bits, says the bucket, the lower bits of `low` are kept in it; row: the place of a band's text."""
    bucket = (high * np.uint64(buckets)) >> np.uint64(32)
    rec = np.sort((bucket << np.uint64(HASH_BITS + 15)) | (row << np.uint64(HASH_BITS)) | (low & np.uint64((1 << HASH_BITS) - 1)))
    cuts = np.searchsorted(rec, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(HASH_BITS + 15))
    row = ((rec >> np.uint64(HASH_BITS)) & np.uint64((1 << 15) - 1)).astype(np.int64)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        there, count = np.unique(row[cuts[b] : cuts[b + 1]], return_counts=True)
        yield b, _block(key[there], sketch[there], count, rec[cuts[b] : cuts[b + 1]])


def _parts(batch: pa.RecordBatch):
    """(k1, k2, texts) of the distinct texts of a batch, at most 8,192 at a time."""
    k1, k2, texts = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), batch.column("t")
    first = np.sort(_first_of(k1, k2))
    for at in range(0, len(first), 1 << 13):
        part = first[at : at + (1 << 13)]
        yield k1[part], k2[part], texts.take(pa.array(part)).to_pylist()


def _pack(plan: Plan, buckets: np.ndarray, heavy: np.ndarray):
    """Blocks of (bucket, hashes); a block of one heavy value has the bucket -1 - its place."""
    names, buckets = buckets.tolist(), len(buckets)

    def run(batches):
        for batch in batches:
            for k1, k2, texts in _parts(batch):
                text, long, sig = _all_signatures(texts, plan)
                key, sketch, h = np.empty(len(text), _KEY), _sketch(sig, plan), _bands(sig, long, plan)
                key["k1"], key["k2"] = k1[text], k2[text]
                ids, blocks = [], []
                row = np.repeat(np.arange(len(text), dtype=np.uint64), plan.bands)
                h = h.ravel()
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    hit = heavy[place] == h
                    for v in np.unique(place[hit]).tolist():
                        r = np.unique(row[hit & (place == v)]).astype(np.int64)
                        ids.append(-1 - v)
                        blocks.append(_block(key[r], sketch[r], np.zeros(len(r), np.int64), np.empty(0, np.uint64)))
                    h, row = h[~hit], row[~hit]
                for b, block in _by_bucket(key, sketch, h >> np.uint64(32), h, row, buckets):
                    ids.append(names[b])
                    blocks.append(block)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return run


def _sign(plan: Plan, heavy: np.ndarray):
    """Each text's key, sketch, the places of the heavy values that it has, and 32 bits of each band's hash, a column a round."""
    cuts = range(0, plan.bands, ROUND_BANDS)

    def run(batches):
        for batch in batches:
            for k1, k2, texts in _parts(batch):
                text, long, sig = _all_signatures(texts, plan)
                h, sketch = _bands(sig, long, plan), _sketch(sig, plan)
                w = np.minimum(h >> np.uint64(32), np.uint64(GONE - 1)).astype("<u4")
                own: list[list[int] | None] = [None] * len(text)
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    hit = heavy[place] == h
                    w[hit] = GONE
                    for r in np.flatnonzero(hit.any(axis=1)).tolist():
                        own[r] = np.unique(place[r][hit[r]]).tolist()
                as_bytes = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
                columns = [pa.array(k1[text]), pa.array(k2[text]), as_bytes(sketch), pa.array(own, pa.list_(pa.int32())), *(as_bytes(w[:, c : c + ROUND_BANDS]) for c in cuts)]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "s", "heavy", *(f"h{r}" for r in range(len(cuts)))])

    return run


def _keys_and_sketches(batch: pa.RecordBatch | pa.Table, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    key = np.empty(batch.num_rows, _KEY)
    key["k1"], key["k2"] = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
    return key, np.frombuffer(b"".join(batch.column("s").to_pylist()), np.uint64).reshape(-1, plan.sketch_words)


def _pack_round(plan: Plan, buckets: np.ndarray):
    """`_pack` for the hashes of one round."""
    names, buckets = buckets.tolist(), len(buckets)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                key, sketch = _keys_and_sketches(part, plan)
                h = np.frombuffer(b"".join(part.column("h").to_pylist()), "<u4").reshape(len(key), -1)
                row = np.repeat(np.arange(len(key), dtype=np.uint64), h.shape[1])
                h = h.ravel().astype(np.uint64)
                light = h != GONE
                found = list(_by_bucket(key, sketch, h[light], h[light], row[light], buckets))
                yield pa.RecordBatch.from_arrays([pa.array([names[b] for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "block"])

    return run


def _block(key: np.ndarray, sketch: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> bytes:
    """Keys, sketches and numbers of hashes of some texts, then the hashes one text after another, the lower 24 bits of each in three bytes."""
    low = np.ascontiguousarray(hashes.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
    return b"".join(x.tobytes() for x in (np.array([len(key)], np.int64), key, sketch, count.astype(np.uint16), low))


def _unpack(block: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sketches, hashes, place of each hash's text)."""
    n, at = int(np.frombuffer(block, np.int64, 1)[0]), 8
    key = np.frombuffer(block, _KEY, n, at)
    at += _KEY.itemsize * n
    sketch = np.frombuffer(block, np.uint64, n * words, at).reshape(n, words)
    at += 8 * n * words
    count = np.frombuffer(block, np.uint16, n, at).astype(np.int64)
    low = np.frombuffer(block, np.uint8, 3 * int(count.sum()), at + 2 * n).reshape(-1, 3).astype(np.uint64)
    return key, sketch, low[:, 0] | low[:, 1] << np.uint64(8) | low[:, 2] << np.uint64(16), np.repeat(np.arange(n), count)


_PAIR = "a1 long, a2 int, b1 long, b2 int"


def _pairs(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Two columns of keys, the smaller key first."""
    swap = (a["k1"] > b["k1"]) | ((a["k1"] == b["k1"]) & (a["k2"] > b["k2"]))
    lo, hi = np.where(swap, b, a), np.where(swap, a, b)
    return {f"{side}{k}": np.ascontiguousarray(x[f"k{k}"]) for side, x in (("a", lo), ("b", hi)) for k in (1, 2)}


def _near(x: np.ndarray, y: np.ndarray, plan: Plan) -> np.ndarray:
    apart = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int32)
    for w in range(plan.sketch_words):
        apart += np.bitwise_count(x[..., w] ^ y[..., w])
    return apart <= plan.most_apart


def _compare(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        keys, sketches, hashes, docs, base = [], [], [], [], 0
        for block in table.column("block"):
            k, s, x, r = _unpack(block.as_py(), plan.sketch_words)
            keys.append(k), sketches.append(s), hashes.append(x), docs.append(r.astype(np.int64) + base)
            base += len(k)
        key, sketch = np.concatenate(keys), np.concatenate(sketches)
        order = np.argsort(np.ascontiguousarray(key["k1"]))  # a text that several batches have is one
        k1, k2 = key["k1"][order], key["k2"][order]
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        back = np.empty(len(key), np.int64)
        back[order] = np.cumsum(new) - 1
        key, sketch = key[order[new]], sketch[order[new]]
        rec = _distinct((np.concatenate(hashes) << np.uint64(32)) | back[np.concatenate(docs)].astype(np.uint64))
        h, doc = rec >> np.uint64(32), (rec & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        # place of the last record of each record's group: partners at distance d exist up to there
        last = np.repeat(start + size - 1, size)
        at, d, found, held = np.arange(len(h)), 1, [], 0
        while True:
            at = at[at + d <= last[at]]
            if not len(at):
                break
            for c in range(0, len(at), 1 << 18):
                a, b = doc[at[c : c + (1 << 18)]], doc[at[c : c + (1 << 18)] + d]
                ok = _near(sketch[a], sketch[b], plan)
                a, b = a[ok], b[ok]
                found.append((np.minimum(a, b).astype(np.uint64) << np.uint64(32)) | np.maximum(a, b).astype(np.uint64))
                held += len(a)
            if held > 1 << 21:
                found = [_distinct(np.concatenate(found))]
                held = 0
            d += 1
        pair = _distinct(np.concatenate(found)) if found else np.empty(0, np.uint64)
        return pa.table(_pairs(key[(pair >> np.uint64(32)).astype(np.int64)], key[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]))

    return run


def _compare_blocks(plan: Plan):
    """Pairs of texts of two blocks of one heavy value."""

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                (ka, sa, *_), (kb, sb, *_) = _unpack(x.as_py(), plan.sketch_words), _unpack(y.as_py(), plan.sketch_words)
                for c in range(0, len(ka), 256):
                    i, j = np.nonzero(_near(sa[c : c + 256, None], sb[None], plan))
                    a, b = ka[i + c], kb[j]
                    other = a != b
                    if other.any():
                        yield pa.RecordBatch.from_pydict(_pairs(a[other], b[other]))

    return run


def _heavy_values(texts: DataFrame, plan: Plan, rows: int, heavy: int, sample: int, thinned=None) -> np.ndarray:
    """Band values that, by a sample of about `sample` texts, more than `heavy` texts share; at most sample * bands / 4 of them.

    thinned: gives a share of `texts` where that can be taken before texts are made.
    """
    if rows <= heavy:
        return np.empty(0, np.uint64)
    share = min(1.0, sample / rows)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                text, long, sig = _all_signatures(batch.column("t").to_pylist(), plan)
                yield pa.RecordBatch.from_arrays([pa.array(_bands(sig, long, plan).ravel().view(np.int64))], names=["h"])

    some = texts.select("t") if share == 1.0 else thinned(share).select("t") if thinned else texts.select("t").sample(fraction=share, seed=1)
    counts = some.distinct().mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") > max(4, heavy * share)).select("h").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def candidate_pairs(texts: DataFrame, plan: Plan = Plan(), rows: int | None = None, heavy: int = HEAVY, sample: int = SAMPLE, thinned=None) -> DataFrame:
    """texts: (key STRUCT<k1: BIGINT, k2: INT>, t STRING), equal texts under one key. Gives (a1, a2, b1, b2): pairs of keys worth verifying.

    rows: about how many texts there are, where a count is at hand; it only sets the number of buckets.
    """
    rows = texts.count() if rows is None else rows
    values = _heavy_values(texts, plan, rows, heavy, sample, thinned)
    if rows > ROUND_TEXTS:
        return _pairs_in_rounds(texts, plan, rows, values)
    buckets = max(1, -(-rows * plan.bands // BUCKET_RECORDS))
    blocks = texts.select("key.k1", "key.k2", "t").mapInArrow(_pack(plan, _even_keys(texts.sparkSession, buckets), values), "bucket int, block binary")
    if len(values):
        blocks = Shelf(texts.sparkSession, "bands").put(blocks)
    # so many tasks as buckets: a task's share doesn't grow with the data
    light = blocks.filter("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_compare(plan), _PAIR)
    if len(values):
        light = light.unionByName(_heavy_pairs(blocks.filter("bucket < 0").withColumn("i", F.xxhash64("block")), plan))
    return light.distinct()


def _heavy_pairs(own: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of texts that share a heavy value; own: (bucket, i, block), i tells the blocks of a value apart."""
    tasks = own.groupBy("bucket").agg(F.count("*").alias("m")).agg(F.sum(F.expr("m * (m + 1) div 2"))).first()[0] or 1
    two = own.select("bucket", "i", F.col("block").alias("x")).join(own.select("bucket", F.col("i").alias("j"), F.col("block").alias("y")), "bucket").filter("i <= j")
    return two.select("x", "y").repartition(min(int(tasks), 20_000)).mapInArrow(_compare_blocks(plan), _PAIR)


def _pairs_in_rounds(texts: DataFrame, plan: Plan, rows: int, values: np.ndarray) -> DataFrame:
    """`candidate_pairs` for many texts: what a text takes on disk and what a bucket holds don't grow with their number."""
    spark = texts.sparkSession
    shelf = Shelf(spark, "bands")
    rounds = len(range(0, plan.bands, ROUND_BANDS))
    schema = "k1 long, k2 int, s binary, heavy array<int>, " + ", ".join(f"h{r} binary" for r in range(rounds))
    signed = shelf.put(texts.select("key.k1", "key.k2", "t").mapInArrow(_sign(plan, values), schema))
    names = _even_keys(spark, max(1, -(-rows * min(ROUND_BANDS, plan.bands) // BUCKET_TEXTS)))
    found = None
    for r in range(rounds):
        blocks = signed.select("k1", "k2", "s", F.col(f"h{r}").alias("h")).mapInArrow(_pack_round(plan, names), "bucket int, block binary")
        part = shelf.put(blocks.repartition(len(names), "bucket").groupBy("bucket").applyInArrow(_compare(plan), _PAIR).distinct())
        found = part if found is None else found.unionByName(part)
        del blocks
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffle files go once the driver has no plan left that reads them
    if len(values):
        own = shelf.put(signed.filter("heavy IS NOT NULL").select(F.explode("heavy").alias("bucket"), "k1", "k2", "s").distinct())
        n = own.groupBy("bucket").agg(F.ceil(F.count("*") / HEAVY_BLOCK).alias("n"))
        own_blocks = shelf.put(own.join(n, "bucket").withColumn("i", F.pmod(F.xxhash64("k1", "k2"), "n")).groupBy("bucket", "i").applyInArrow(_heavy_block(plan), "bucket int, i long, block binary"))
        shelf.drop(own)
        found = found.unionByName(shelf.put(_heavy_pairs(own_blocks, plan).distinct()))
        shelf.drop(own_blocks)
    shelf.drop(signed)
    return found.distinct()


def _heavy_block(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        key, sketch = _keys_and_sketches(table, plan)
        block = _block(key, sketch, np.zeros(len(key), np.int64), np.empty(0, np.uint64))
        return pa.table({"bucket": table.column("bucket")[:1], "i": table.column("i")[:1], "block": pa.array([block], pa.binary())})

    return run


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as numbers: all of them one after another, where each text's begin, and how many."""
    texts = [t if len(t) >= n else t.ljust(n, "\0") for t in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    used = np.zeros(int(code.max()) + 1, bool)
    used[code] = True
    dense = (np.cumsum(used) - 1)[code].astype(np.uint64)
    width = np.uint64(int(dense.max()).bit_length() or 1)
    of = np.repeat(np.arange(len(texts)), lens)
    gram = np.zeros(len(code) - n + 1, np.uint64)
    for i in range(n):  # exact: after each character the numbers are made dense again where they outgrow a word
        if i and int(gram.max()).bit_length() + int(width) > 63:
            gram = np.searchsorted(_distinct(gram), gram).astype(np.uint64)
        gram = (gram << width) | dense[i : len(code) - n + 1 + i]
    gram = gram[of[: len(gram)] == of[n - 1 :]]
    gram = np.searchsorted(_distinct(gram), gram).astype(np.uint64)
    own = _distinct((np.repeat(np.arange(len(texts), dtype=np.uint64), lens - n + 1) << np.uint64(32)) | gram)
    count = np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    return own & np.uint64(0xFFFFFFFF), np.cumsum(count) - count, count


def _slices(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))


def jaccard(left: list[str], right: list[str], n: int) -> np.ndarray:
    """Exact Jaccard similarity of the distinct n-grams of each pair of texts."""
    place: dict[str, int] = {}
    a = np.fromiter((place.setdefault(t, len(place)) for t in left), np.int64, len(left))
    b = np.fromiter((place.setdefault(t, len(place)) for t in right), np.int64, len(right))
    if not len(a):
        return np.empty(0)
    gram, start, count = _grams(list(place), n)
    both = np.empty(len(a), np.int64)
    step = 4096
    for c in range(0, len(a), step):
        x, y = a[c : c + step], b[c : c + step]
        pair = np.arange(len(x), dtype=np.uint64) << np.uint64(32)
        z = np.sort(np.concatenate([np.repeat(pair, count[v]) | gram[_slices(start[v], count[v])] for v in (x, y)]))
        same = z[1:][z[1:] == z[:-1]] >> np.uint64(32)
        both[c : c + step] = np.bincount(same.astype(np.int64), minlength=len(x))
    return both / (count[a] + count[b] - both)


def _verify(n: int):
    def run(batches):
        for x in batches:
            s = jaccard(x.column("ta").to_pylist(), x.column("tb").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("a1", "a2", "b1", "b2")), pa.array(s, pa.float64())], names=["a1", "a2", "b1", "b2", "similarity"])

    return run


def similar_texts(texts: DataFrame, plan: Plan = Plan(), rows: int | None = None, **how) -> DataFrame:
    """(a1, a2, b1, b2, similarity) of the pairs of different normalised texts with Jaccard similarity >= plan.limit."""
    pairs = candidate_pairs(texts, plan, rows, **how)
    reps = texts.groupBy("key.k1", "key.k2").agg(F.first("t").alias("t"))
    both = (
        pairs.join(reps.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("t").alias("ta")), ["a1", "a2"])
        .join(reps.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("t").alias("tb")), ["b1", "b2"])
        .select("a1", "a2", "b1", "b2", "ta", "tb")
    )
    return both.mapInArrow(_verify(plan.n), f"{_PAIR}, similarity double").filter(F.col("similarity") >= plan.limit)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, t) for rows whose id isn't null and whose text has a letter or digit."""
    t = df.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL AND t <> ''")
    return t.select("id", F.struct(F.xxhash64("t").alias("k1"), F.hash(F.lit(1), "t").alias("k2")).alias("key"), "t")


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", plan: Plan = Plan(), **how) -> DataFrame:
    """(function_a, function_b), a < b: all pairs of different ids whose texts are at least plan.limit alike.

    Rows with a null id, or a text that is null or without letters and digits, are in no pair; repeated rows count once;
    a text shorter than n characters is its own only n-gram; texts are compared whole, however long.
    """
    rows = keyed(df, id_col, text_col)
    similar = similar_texts(rows.select("key", "t"), plan, df.count(), thinned=lambda share: keyed(df.sample(fraction=share, seed=1), id_col, text_col), **how)
    member = rows.select("key.k1", "key.k2", "id").distinct()
    same = member.join(member.select("k1", "k2", F.col("id").alias("id2")), ["k1", "k2"]).filter("id < id2").select(F.col("id").alias("function_a"), F.col("id2").alias("function_b"))
    a = member.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("id").alias("x"))
    b = member.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("id").alias("y"))
    cross = similar.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select(F.least("x", "y").alias("function_a"), F.greatest("x", "y").alias("function_b"))
    return cross.unionByName(same).filter("function_a <> function_b").distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """(function_id, group_id, n_links): each id with the smallest id that near-duplicate texts tie it to, and how many other texts its own is close to.

    Groups are made between distinct texts and then given to all rows that have them; copies are not paired up. An id whose
    text is null or without letters and digits is alone.
    """
    rows = keyed(df, id_col, text_col)
    shelf = Shelf(df.sparkSession, "near-groups")
    node = lambda x: F.struct(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2"))
    links = shelf.put(similar_texts(rows.select("key", "t"), plan, df.count(), thinned=lambda share: keyed(df.sample(fraction=share, seed=1), id_col, text_col)).select(node("a").alias("a"), node("b").alias("b")))
    labels = propagate_min(links.select(F.col("a").alias("u"), F.col("b").alias("v")), shelf)
    n = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    of_key = labels.select(F.col("node").alias("key"), "label").join(n, "key").select("key.*", "label", "n_links")
    member = shelf.put(rows.select("key.k1", "key.k2", "id").distinct().join(of_key, ["k1", "k2"], "left"))
    member = member.select("id", F.coalesce("label", node("k")).alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    low = member.groupBy("label").agg(F.min("id").alias("group_id"))
    of = member.join(low, "label").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links"))
    every = df.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct().join(of, "id", "left")
    return every.select(F.col("id").alias("function_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
