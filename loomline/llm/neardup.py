"""Near-duplicate groups over word-shingle sets, by vantage-point search over fingerprints.

1. Each document becomes a set of word shingles, of which MinHash keeps ``bands * rows`` minima. One
   bit of each makes a fingerprint whose Hamming distance estimates dissimilarity
   (expected share of differing bits: (1 - J) / 2), and ``bands`` keys name the shards it belongs to.
2. Documents with equal shingle sets are one class; only one of them is searched.
3. A class goes to the shard of each of its keys. In a shard the fingerprints are
   partitioned by their Hamming distance to vantage points; a query visits a side
   only if the triangle inequality lets it hold something within the radius, so boundary fingerprints
   are searched on both sides. Shards over ``block`` classes are split into blocks and every pair of blocks is
   searched in a task of its own: no shard is sampled or cut.
4. Every pair within the radius is verified on the shingle sets themselves.

With unrelated texts the Hamming distances to any vantage point pile up around half the bits,
so no radius that admits a similarity of 0.6 prunes a tree over the whole collection; that is why
the tree is searched inside shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import cut
from loomline.llm.words import arrow_map, grams, hash_words, mix, words

BANDS, ROWS = 48, 4
BITS = BANDS * ROWS
LEAF = 24
BROADCAST_IDS = 500_000


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, BITS, dtype=np.uint64)[:, None]


_A, _B = _factors()
_PACK = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of ``n`` words."""
    return np.unique(grams(hash_words(words(text)), n))


def signature(s: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(class id, shard keys, fingerprint words) of a non-empty shingle set."""
    low = np.full(BITS, np.uint64(2**64 - 1))
    for at in range(0, len(s), 512):  # keeps the product in the cache
        np.minimum(low, (_A * s[None, at : at + 512] + _B).min(axis=1), out=low)
    own = mix(low)
    keys = np.zeros(BANDS, np.uint64)
    per = own.reshape(BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys + per[:, r] + np.uint64(r + 1))
    keys = mix(keys ^ np.arange(BANDS, dtype=np.uint64))
    bits = (own >> np.uint64(63)).reshape(-1, 64)
    return int(mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))), keys, (bits * _PACK).sum(axis=1, dtype=np.uint64)


def signatures(df: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    """(id, class, keys, print) of each row whose text has at least ``n`` words and whose key isn't null."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, cls, keys, prints = [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingles(t, n)
            if len(s):
                c, k, p = signature(s)
                ids.append(i), cls.append(c), keys.append(k), prints.append(p)
        m = len(ids)
        flat = np.concatenate(keys) if m else np.empty(0, np.uint64)
        marks = np.concatenate(prints) if m else np.empty(0, np.uint64)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * w), pa.array(x.view(np.int64))) for x, w in ((flat, BANDS), (marks, BITS // 64))]
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(np.array(cls, np.uint64).view(np.int64)), *lists], names=["id", "class", "keys", "print"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(arrow_map(sign), f"id {kind}, class bigint, keys array<bigint>, print array<bigint>")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def tree_pairs(home: np.ndarray, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, query) of fingerprints within ``radius``, by a vantage-point tree over ``home``."""
    stack = [(np.arange(len(home)), np.arange(len(query)))]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) <= LEAF or len(q) <= LEAF:
            for at in range(0, len(h), LEAF):
                block = h[at : at + LEAF]
                x, y = np.nonzero(_distance(home[block][:, None, :], query[q][None, :, :]) <= radius)
                yield block[x], q[y]
            continue
        vantage = home[h[len(h) // 2]]
        dh, dq = _distance(home[h], vantage), _distance(query[q], vantage)
        mid = int(np.median(dh))
        near = dh <= mid
        if near.all():
            near = dh < mid
        if not near.any():  # all at one distance: no split helps
            for at in range(0, len(h), LEAF):
                block = h[at : at + LEAF]
                x, y = np.nonzero(_distance(home[block][:, None, :], query[q][None, :, :]) <= radius)
                yield block[x], q[y]
            continue
        stack.append((h[near], q[dq <= int(dh[near].max()) + radius]))
        stack.append((h[~near], q[dq >= int(dh[~near].min()) - radius]))


def _search(radius: int):
    """For sorted rows (key, side, class, print): class pairs within the radius, shard by shard.

    side: 0 both home and query, 1 home only, 2 query only.
    """

    def shard(side: np.ndarray, cls: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, q = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        left, right = [], []
        for x, y in tree_pairs(prints[h], prints[q], radius):
            left.append(cls[h[x]]), right.append(cls[q[y]])
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
        return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                both = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        def work(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            key, side, cls, p = (np.concatenate(x) for x in zip(*parts))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            # small shards: all at once, by distance in the sorted order
            small = np.repeat((sizes <= LEAF) & (sizes > 1), sizes)
            for step in range(1, int(min(LEAF, sizes.max()))):
                at = np.flatnonzero(small[:-step] & (key[:-step] == key[step:]) & (side[:-step] == 0) & (side[step:] == 0) & (cls[:-step] != cls[step:]))
                at = at[_distance(p[at], p[at + step]) <= radius]
                yield from emit(np.minimum(cls[at], cls[at + step]), np.maximum(cls[at], cls[at + step]))
            for s in np.flatnonzero((sizes > LEAF) | ((sizes > 1) & (np.maximum.reduceat(side, starts) > 0))):
                r = slice(starts[s], starts[s] + sizes[s])
                yield from emit(*shard(side[r], cls[r], p[r]))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            prints = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, batch.num_columns)], axis=1).view(np.uint64)
            part = (*cols, prints)
            last = np.flatnonzero(cols[0] != cols[0][-1])  # the final shard may go on in the next batch
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield from work([*held, tuple(c[:end] for c in part)])
                held = []
            held.append(tuple(c[end:] for c in part))
        if held:
            yield from work(held)

    return run


def candidate_pairs(classes: DataFrame, radius: int, block: int, width: int = BITS // 64) -> DataFrame:
    """Distinct class pairs (a < b) that share a shard and lie within the radius.

    ``classes``: class, keys (the shards), print (``width`` words of 64 bits).
    """
    words_ = [F.col("print")[i].alias(f"p{i}") for i in range(width)]
    rows = classes.select(F.explode("keys").alias("key"), "class", *words_)
    big = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    n_big = big.count()
    rows = rows.withColumn("side", F.lit(0).cast("bigint"))
    if n_big:
        tagged = rows.join(F.broadcast(big) if n_big <= 100_000 else big, "key", "left")
        own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
        tagged = tagged.withColumn("own", own)
        # a row meets every block once: as home towards later blocks, as query towards earlier ones, as both in its own
        spread = tagged.where("blocks IS NOT NULL").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("bigint")
        cols = ["class", *[f"p{i}" for i in range(width)]]
        spread = spread.select(pair.alias("key"), *cols, side.alias("side"))
        rows = tagged.where("blocks IS NULL").select("key", *cols, "side").union(spread)
    rows = rows.select("key", "side", "class", *[f"p{i}" for i in range(width)])
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_search(radius), "a bigint, b bigint")
    return found.distinct()


def near_duplicates(df: DataFrame, key: str, text: Column, n: int = 5, threshold: float = 0.8, radius: int | None = None, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of equal shingle sets, and verified links between them.

    members: id, class. links: class_a, class_b, shared, total, similarity >= ``threshold``; each link
    once. Texts of fewer than ``n`` words (null and empty ones too) have no shingles and are in no class;
    null keys are left out; repeated rows count once. The radius defaults to the
    expected distance at the threshold plus 4.6 standard deviations. A pair at the very threshold
    shares no shard with probability (1 - t^4)^48 (0.6: 0.13 %, 0.65: 0.01 %, 0.8: under 1e-10).
    """
    if radius is None:
        p = (1 - threshold) / 2
        radius = int(np.ceil(BITS * p + 4.6 * np.sqrt(BITS * p * (1 - p))))
    signed = cut(signatures(df, key, text, n))
    members = signed.select("id", "class").distinct()
    # equal classes have equal keys and prints: any of them stands for all
    classes = signed.groupBy("class").agg(F.min("id").alias("id"), F.min_by("keys", "id").alias("keys"), F.min_by("print", "id").alias("print"))
    pairs = cut(candidate_pairs(classes.drop("id"), radius, block))
    return members, verified_links(df, key, text, members, pairs, n, threshold)


def verified_links(df: DataFrame, key: str, text: Column, members: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets have at least the similarity ``threshold``.

    Only texts that stand for a class in some pair are read again.
    """
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b"))).distinct()
    stands = cut(members.groupBy("class").agg(F.min("id").alias("id")).join(ends, "class", "left_semi"))
    # the texts are not shuffled while the ids are few enough to broadcast
    wanted = F.broadcast(stands.select("id")) if stands.count() <= BROADCAST_IDS else stands.select("id")
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, n) for t in batch.column(1).to_pylist()]
        at = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
        flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "set"])

    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), text.alias("text")).join(wanted, "id", "left_semi")
    whole = texts.mapInArrow(arrow_map(sets), f"id {kind}, set array<bigint>").join(stands, "id").dropDuplicates(["class"]).select("class", "set")
    left, right = whole.select(F.col("class").alias("a"), F.col("set").alias("set_a")), whole.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").where((F.size("set_a") > 0) & (F.size("set_b") > 0))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    out = both.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), shared.cast("bigint").alias("shared"), (F.size("set_a") + F.size("set_b")).cast("bigint").alias("sum"))
    out = out.select("class_a", "class_b", "shared", (F.col("sum") - F.col("shared")).alias("total")).withColumn("similarity", F.col("shared") / F.col("total"))
    return out.where(F.col("similarity") >= threshold)


def id_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All linked pairs of ids (id_a < id_b), copies included."""
    a = members.select(F.col("class").alias("class_a"), F.col("id").alias("x"))
    b = members.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    across = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = a.join(b, F.col("class_a") == F.col("class_b")).where(F.col("x") < F.col("y")).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.union(within)
