"""Connected components of a link table, by alternating large-star and small-star steps.

Each round is two aggregations over the links; the number of rounds grows with the logarithm of a
component's size. Up to ``FEW`` links are solved by one task. Else links stay in distributed tables that are written to the shared folder after each
round; what reaches the driver is one count and one checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import cut


HUB = 1_000_000  # neighbours; no more than one in so many links can end at a node with more


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Connects neighbours to the least id of a node's neighbourhood (itself included).

    Large star: the greater neighbours of each node; small star: the node and its lesser ones.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # the least neighbour is an aggregate, so a hub shrinks before it moves; its links then stay where they are
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > HUB).drop("n"))
    near = both.join(hubs, "u").unionByName(both.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= HUB).drop("n"), "u"))
    near = near.withColumn("m", F.least("u", "m"))
    if large:
        return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    pointing = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return pointing.union(near.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


FEW = 200_000  # links that one task solves at once; more take rounds


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded number of links; the root of a component is its least id."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        ids = list(root)
        kind = schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([find(x) for x in ids], kind)], names=["id", "component"])


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id with a link to another; the component is its least id.

    Links are undirected. Rows with a null end and links of an id to itself are left out;
    repeated links count once; no links give no rows. Ids may be of any orderable type.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    now, before = cut(now), None
    if now.count() <= FEW:
        kind = now.schema["a"].dataType.simpleString()
        return now.repartition(1).mapInArrow(_solve, f"id {kind}, component {kind}")
    for _ in range(most_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if mark == before:
            stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return stars.union(now.select("b", "b").distinct())
        before = mark
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
