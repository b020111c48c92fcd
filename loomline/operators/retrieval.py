"""Vector scoring, ranking and retrieval metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(corpus: DataFrame, queries: DataFrame, doc: str, query: str, vector: str, k: int, most_bytes: int = 256_000_000) -> DataFrame:
    """(query, doc, score, rank): the ``k`` best documents of each query by cosine, ties by document id.

    The queries are scored in blocks whose size is checked against ``most_bytes``; each block is broadcast and meets every document once, as a
    matrix product per batch that keeps k candidates per query and batch. Null vectors take no part.
    """
    spark = corpus.sparkSession
    qs = queries.where(F.col(vector).isNotNull()).select(F.col(query).cast("bigint").alias("q"), F.col(vector).alias("v"))
    n, dim = qs.agg(F.count("*"), F.max(F.size("v"))).first()
    docs = corpus.where(F.col(vector).isNotNull()).select(F.col(doc).cast("bigint").alias("d"), F.col(vector).alias("v"))
    schema = "query bigint, doc bigint, score double"
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    blocks = max(1, -(-n * dim * 8 // most_bytes))
    found = None
    for b in range(blocks):
        rows = qs.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()  # no Python floats on the way
        ids = rows.column("q").to_numpy()
        m = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        share = spark.sparkContext.broadcast((ids, m))

        def score(batches, share=share):
            ids, m = share.value
            for batch in batches:
                d = np.asarray(batch.column(0))
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                s = m @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T
                keep = min(k, len(d))
                order = np.lexsort((np.broadcast_to(d, s.shape), -np.round(s, 12)))[:, :keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep)), pa.array(d[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query", "doc", "score"])

        part = docs.mapInArrow(score, schema)
        found = part if found is None else found.union(part)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.round("score", 12).desc(), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(found: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of already found (query, doc) by another score; pairs without one come last, ties by document id.

    ``scores``: query, doc, score. Only found pairs are looked at.
    """
    both = found.select("query", "doc").join(scores.select("query", "doc", "score"), ["query", "doc"], "left")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc_nulls_last("score"), "doc"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def with_distractors(corpus: DataFrame, others: DataFrame, order: list[str], most: int = 2000) -> DataFrame:
    """The corpus and, behind it, the first ``most`` of the other rows as distractors (``is_distractor``)."""
    return corpus.withColumn("is_distractor", F.lit(False)).unionByName(others.orderBy(*order).limit(most).withColumn("is_distractor", F.lit(True)))


def metrics(ranks: DataFrame, rank: str, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Means over queries with one relevant document each, from its rank (null: not retrieved)."""
    r = F.col(rank)
    cols = []
    for k in at:
        hit = F.when(r <= k, 1.0).otherwise(0.0)
        cols += [F.round(F.avg(hit), 6).alias(f"accuracy_at_{k}"), F.round(F.avg(hit / k), 6).alias(f"precision_at_{k}"), F.round(F.avg(hit), 6).alias(f"recall_at_{k}")]
    cols.append(F.round(F.avg(F.when(r <= 10, 1 / F.log2(r + 1)).otherwise(0.0)), 6).alias("ndcg_at_10"))
    cols.append(F.round(F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)), 6).alias("mrr_at_10"))
    cols.append(F.round(F.avg(F.when(r <= 100, 1 / r).otherwise(0.0)), 6).alias("map_at_100"))
    return ranks.agg(F.count("*").alias("n_queries"), *cols)


def batches_without_repeats(df: DataFrame, anchor: str, order: str, size: int) -> DataFrame:
    """``batch``: no anchor occurs twice in a batch of at most ``size`` rows.

    Rows with the k-th occurrence of their anchor form layer k; each layer is cut into batches.
    """
    salts = max(1, math.ceil(df.count() / 100_000))
    layer = df.withColumn("layer", F.row_number().over(W.partitionBy(anchor).orderBy(order)))
    at = F.row_number().over(W.partitionBy("layer", "_salt").orderBy(anchor)) - 1
    salted = layer.withColumn("_salt", F.pmod(F.xxhash64(anchor), F.lit(salts)))
    return salted.withColumn("batch", F.concat_ws("-", "layer", "_salt", F.floor(at / size))).drop("_salt")
