"""Filling fixed-capacity containers: minimum bin slack over a histogram of sizes.

Documents matter to packing only by their size, so all that is gathered is, per profile, the count
of items of each size: at most ``capacity`` rows, whatever the corpus. Over this histogram a
subset-sum bitset finds the fullest feasible container with the largest size left; that
combination is taken as often as the counts allow, removed, and the search goes on. Documents are then
given their container by their rank among items of equal size. The ranks are computed in salted groups, so a
size that a third of all documents share is no hot key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.session import cut

# The published GPT-2 pre-tokenizer pattern (fixed value), with Unicode classes.
PRETOKENS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pretoken_count(text: Column) -> Column:
    """Number of pre-tokens; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(PRETOKENS)), F.lit(0)).cast("bigint")


def _add(reach: int, size: int, count: int, total: int) -> int:
    """The bitset of sums once up to ``count`` items of a size may be added."""
    full, left, step = (1 << (total + 1)) - 1, min(count, total // size), 1
    while left > 0:
        take = min(step, left)
        reach |= (reach << (take * size)) & full
        left -= take
        step *= 2
    return reach


def fullest(total: int, sizes: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination with the largest sum not over ``total``; larger sizes are preferred.

    Bitsets are kept at every so manieth size and made again in between, so memory grows with the root of their number.
    """
    order = sorted((s for s in sizes if 0 < s <= total and counts[s] > 0))
    width = math.isqrt(len(order)) + 1
    blocks = [order[k : k + width] for k in range(0, len(order), width)]
    marks, reach = [], 1
    for block in blocks:
        marks.append(reach)
        for s in block:
            reach = _add(reach, s, counts[s], total)
    rest = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for mark, block in zip(reversed(marks), reversed(blocks)):
        before = [mark]
        for s in block[:-1]:
            before.append(_add(before[-1], s, counts[s], total))
        for s, reach in zip(reversed(block), reversed(before)):
            for k in range(min(counts[s], rest // s), -1, -1):
                if (reach >> (rest - k * s)) & 1:
                    if k:
                        chosen[s] = k
                    rest -= k * s
                    break
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Container patterns [({size: times}, containers)] that use up the histogram."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    while counts:
        big = max(counts)
        if big == 0:
            out.append(({0: counts.pop(0)}, 1))
            break
        left = dict(counts)
        left[big] -= 1
        combo = fullest(capacity - big, list(left), left)
        combo[big] = combo.get(big, 0) + 1
        times = min(counts[s] // k for s, k in combo.items())
        out.append((combo, times))
        for s, k in combo.items():
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
    return out


def pieces(docs: DataFrame, profiles: DataFrame, doc_id: str, size: Column) -> tuple[DataFrame, int]:
    """Documents as items: profile_id, capacity, doc_id, n_pieces, piece, cost (with the separator); and the number of profiles."""
    p = profiles.select("profile_id", F.col("capacity_tokens").cast("bigint").alias("capacity"), F.col("separator_tokens").cast("bigint").alias("sep")).distinct()
    bad = F.col("sep").isNull() | F.col("capacity").isNull() | (F.col("sep") < 0) | (F.col("capacity") <= F.col("sep"))
    known = p.limit(10_001).collect()  # profiles are configuration
    if len(known) > 10_000:
        raise ValueError("more than 10,000 packing profiles")
    if p.where(bad).limit(1).count():
        raise ValueError("a profile needs capacity_tokens > separator_tokens >= 0")
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size")))  # texts are read once
    if not known:
        profile_list = F.array().cast("array<struct<profile_id:int,capacity:bigint,sep:bigint>>")
    else:
        profile_list = F.array(*[F.struct(F.lit(r.profile_id).cast("int").alias("profile_id"), F.lit(r.capacity).alias("capacity"), F.lit(r.sep).alias("sep")) for r in known])
    rows = sized.withColumn("p", F.explode(profile_list)).select("p.*", "doc_id", "size")
    room = F.col("capacity") - F.col("sep")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / room)).cast("int")
    rows = rows.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    tokens = F.when(F.col("piece") < F.col("n_pieces") - 1, room).otherwise(F.col("size") - room * (F.col("n_pieces") - 1))
    return rows.withColumn("cost", tokens + F.col("sep")).drop("size", "sep"), len(known)


def pack(docs: DataFrame, profiles: DataFrame, doc_id: str, size: Column, salts: int | None = None) -> DataFrame:
    """Every document piece with its container: profile_id, capacity, doc_id, n_pieces, piece, cost, container.

    A document is split only if its size plus the separator is over the capacity: into pieces that fill a
    container each and one rest. Containers are numbered from 0 in each profile. Null texts should be
    given the size 0 (they cost the separator only); null ids and repeated rows are items like
    others; no documents or no profiles give no rows. Ties of size are broken by a hash of the id.
    """
    items, known = pieces(docs, profiles, doc_id, size)
    if salts is None:  # some 500,000 items of one size a group at the most
        salts = max(8, math.ceil(items.count() / 500_000))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    key = ["profile_id", "cost"]
    per_salt = items.groupBy("profile_id", "capacity", "cost", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy(*key).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = per_salt.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))  # at most salts rows a key

    def patterns(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf.capacity.iloc[0])
        used: dict[int, int] = {}
        rows, first = [], 0
        for combo, times in minimum_bin_slack(dict(zip(pdf.cost.astype(int), pdf.n.astype(int))), capacity):
            for s, k in combo.items():
                at = used.get(s, 0)
                rows.append((int(pdf.profile_id.iloc[0]), s, at, k, first))
                used[s] = at + k * times
            first += times
        return pd.DataFrame(rows, columns=["profile_id", "cost", "from_rank", "each", "first"])

    hist = per_salt.groupBy("profile_id", "capacity", "cost").agg(F.sum("n").alias("n"))
    # a task a profile: by number, as partitions by key alone would be put together again
    plan = hist.repartition(max(1, 4 * known), "profile_id").groupBy("profile_id").applyInPandas(patterns, "profile_id int, cost bigint, from_rank bigint, each bigint, first bigint")
    # one array per profile and size, bounded by the capacity (patterns), not by the corpus
    plan = plan.groupBy("profile_id", "cost").agg(F.array_sort(F.collect_list(F.struct("from_rank", "each", "first"))).alias("plan"))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("profile_id", "cost", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "piece")) - 1)
    ranked = ranked.join(starts.select(*key, "salt", "start"), [*key, "salt"]).withColumn("rank", F.col("rank") + F.col("start"))
    # ranks of a group are spread over sorted intervals: the last that starts at or before the rank
    joined = ranked.join(F.broadcast(plan), key)  # its size is bounded by capacity and profiles
    hit = F.element_at(F.filter("plan", lambda p: p["from_rank"] <= F.col("rank")), -1)
    joined = joined.withColumn("hit", hit)
    container = F.col("hit.first") + F.floor((F.col("rank") - F.col("hit.from_rank")) / F.col("hit.each"))
    return joined.select("profile_id", "capacity", "doc_id", "n_pieces", "piece", "cost", container.cast("bigint").alias("container"))
