"""Repetition inside one document, with risk-controlled cutoffs.

``repetition_shares`` measures, per document, the share of its word positions that lie in a run
of ``n`` words which already started at an earlier position. Beside them it can give trials: generated
documents of the row's own words whose repeated share is known by construction. ``risk_cutoffs`` chooses, per
stratum, the lowest share at which documents may be rejected: on the trials, which are no documents of the
table, the exact (Clopper-Pearson) upper bound of the rate at which sound ones are rejected must stay under
``alpha``, at a confidence that is corrected for all strata and grid points tested (Bonferroni).
Nothing is collected: holdouts shrink to one histogram row per stratum and grid step.
"""

from __future__ import annotations

import math
import random
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import cut
from loomline.llm.words import arrow_map, chunks, grams, hash_words, mix, words

GRID = 100  # cutoffs are multiples of 1/GRID
ALL = "(all)"  # the trials of all strata together
TRIAL = "array<struct<share:double,bad:boolean>>"


def repeated(h: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which words of the documents that lie one after the other in ``h`` are in runs of ``n`` seen before in their own document."""
    inside = np.zeros(len(h), bool)
    g = grams(h, n)
    if not len(g):
        return inside
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    whole = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
    again = whole[pd.Series(mix(g[whole] ^ mix(doc[whole] + np.uint64(1)))).duplicated().to_numpy()]
    for k in range(n):
        inside[again + k] = True
    return inside


def _per_document(inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(inside)))[np.concatenate(([0], np.cumsum(sizes)))])


def trial(h: np.ndarray, n: int, limit: float, r: random.Random) -> tuple[np.ndarray, bool] | None:
    """A document made of the words ``h``, none of them repeated, and of repeated runs of them; whether their share is ``limit`` or more.

    Three of four are sound. Shares lie within 0.2 of the limit, so that cutoffs just under it show their risk. None if the words are too few.
    """
    m = len(h)
    if m < 4 * n:
        return None
    share = limit - 0.2 * r.random() if r.random() < 0.75 else limit + 0.2 * r.random()
    left = again = max(n, round(share * m / (1 - share)))
    parts, marks = [h], 0
    while left:
        size = min(left, r.randrange(n, m + 1))
        if 0 < left - size < n:  # the last run needs n words too
            size = left if left <= m else left - n
        at = r.randrange(m - size + 1)
        parts += [np.array([r.getrandbits(64)], np.uint64), h[at : at + size]]  # a new word between the runs keeps them apart
        left, marks = left - size, marks + 1
    return np.concatenate(parts), again >= limit * (m + again + marks)


def repetition_shares(df: DataFrame, key: str, text: Column, keep: dict[str, Column] | None = None, n: int = 4, trials: Column | None = None, limit: float = 0.4) -> DataFrame:
    """One row per input row: ``key``, the columns of ``keep``, n_words, n_repeated, share.

    Null, empty and wordless texts have no words, nothing repeated and a share of 0. Texts
    shorter than ``n`` words repeat nothing. Repeated input rows give repeated output rows; other
    columns of ``df`` are not read. Texts are read whole, a few megabytes at a time. With ``trials`` (how many
    a row gives) there is a column trials: the measured share of each and whether it was made with ``limit`` or more repeated.
    """
    keep, trying = keep or {}, trials is not None
    wanted = F.lit(0) if not trying else F.coalesce(trials.cast("int"), F.lit(0))
    small = df.select(F.col(key).alias("__k"), *[c.alias(f"__{k}") for k, c in keep.items()], wanted.alias("__n"), text.alias("__t"))

    def made(h: np.ndarray, sizes: np.ndarray, inside: np.ndarray, times: list[int]) -> pa.Array:
        docs, bad, count = [], [], []
        for a, b, k in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), times):
            base = h[a:b][~inside[a:b]]
            again = repeated(base, np.array([len(base)]), n)
            while again.any():  # runs may meet where others were taken out
                base = base[~again]
                again = repeated(base, np.array([len(base)]), n)
            r = random.Random(int(h[a:b].sum(dtype=np.uint64)))
            some = [x for x in (trial(base, n, limit, r) for _ in range(k)) if x]
            count.append(len(some))
            docs += [x for x, _ in some]
            bad += [y for _, y in some]
        lens = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        share = _per_document(repeated(flat, lens, n), lens) / np.maximum(lens, 1)
        at = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(share), pa.array(bad, pa.bool_())], names=["share", "bad"]))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, times = batch.column("__t").to_pylist(), batch.column("__n").to_pylist()
        total, again, tries = [], [], []
        for a, b in chunks(texts):
            found = [words(t) for t in texts[a:b]]
            sizes = np.array([len(w) for w in found], np.int64)
            h = hash_words(list(chain.from_iterable(found)))
            inside = repeated(h, sizes, n)
            total.append(sizes), again.append(_per_document(inside, sizes))
            if trying:
                tries.append(made(h, sizes, inside, times[a:b]))
        total, again = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (total, again))
        share = np.divide(again, total, out=np.zeros(len(total)), where=total > 0)
        out = [*batch.columns[:-2], pa.array(total), pa.array(again.astype(np.int64)), pa.array(share)]
        if trying:
            out.append(pa.concat_arrays(tries) if tries else pa.array([], tries_type))
        return pa.RecordBatch.from_arrays(out, names=[*names, "n_words", "n_repeated", "share", *(["trials"] if trying else [])])

    tries_type = pa.list_(pa.struct([("share", pa.float64()), ("bad", pa.bool_())]))
    names = [key, *keep]
    kinds = [f"`{n_}` {f.dataType.simpleString()}" for n_, f in zip(names, small.schema.fields)]
    more = f", trials {TRIAL}" if trying else ""
    return small.mapInArrow(arrow_map(measure), ", ".join(kinds) + ", n_words bigint, n_repeated bigint, share double" + more)


def trials_per_row(df: DataFrame, stratum: Column, most_strata: int, alpha: float, delta: float, ceiling: float) -> DataFrame:
    """(stratum, trials): how many trials each row must give so that its stratum can be certified; one where there are rows enough.

    ``most_strata`` only widens the number asked for; more strata than that are certified by their rows' own trials or by those of all.
    """
    need = math.ceil(1.8 * -math.log(delta / ((most_strata + 1) * (round(ceiling * GRID) + 1))) / alpha)
    rows = df.select(F.coalesce(stratum.cast("string"), F.lit("(null)")).alias("stratum")).groupBy("stratum").agg(F.count("*").alias("n"))
    return rows.select("stratum", F.ceil(need / F.col("n")).cast("int").alias("trials"))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    d = 1.0 - (a + b) * x / (a + 1)
    c, d = 1.0, 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 100_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + t * d
            c = 1.0 + t / c
            c, d = c if abs(c) > tiny else tiny, 1.0 / (d if abs(d) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1.0) < 1e-12:
            break
    return front * f


def binomial_upper(bad: int, total: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound, at confidence 1 - delta, of a rate seen ``bad`` times in ``total``."""
    if total <= 0 or bad >= total:
        return 1.0
    lo, hi = bad / total, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if _beta_cdf(1 - p, total - bad, bad + 1) > delta:  # P(X <= bad) at rate p
            lo = p
        else:
            hi = p
    return hi


def risk_cutoffs(labelled: DataFrame, stratum: str, share: str, bad: str, alpha: float = 0.01, delta: float = 0.05, ceiling: float = 0.6) -> DataFrame:
    """Per stratum, and for all of them together, the lowest cutoff whose false-rejection rate is certified to be under ``alpha``.

    ``labelled`` holds a stratum, a share and a label (true: really defective) per document of the holdout.
    Cutoffs are tested in descending order from ``ceiling`` in steps of 1/GRID and the walk stops at
    the first that fails. Each test runs at confidence ``1 - delta / ((strata + 1) * grid points)``. A
    stratum whose holdout certifies nothing has a null cutoff. Columns: stratum, n_good, n_bad,
    cutoff, bound (the certified upper bound, 1 if none), missed (bad ones under the cutoff).
    A null stratum is a stratum of its own, all together are ``(all)``; null shares or labels are left out; an empty
    holdout gives no rows.
    """
    top = int(round(ceiling * GRID))
    # the step is floor(share * GRID); beyond the ceiling all steps are one
    step = F.least(F.lit(top), F.floor(F.col(share) * GRID + 1e-9).cast("int"))
    hist = labelled.where(F.col(share).isNotNull() & F.col(bad).isNotNull()).select(F.coalesce(F.col(stratum).cast("string"), F.lit("(null)")).alias("stratum"), step.alias("step"), F.col(bad).cast("int").alias("bad"))
    hist = hist.groupBy("stratum", "step").agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad"))
    hist = cut(hist)  # at most GRID + 1 rows a stratum
    strata = 1 + hist.select("stratum").distinct().count()
    hist = hist.union(hist.groupBy("step").agg(F.sum("good"), F.sum("bad")).select(F.lit(ALL), "*"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, wrong = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64)
        np.add.at(good, pdf.step.to_numpy(), pdf.good.to_numpy())
        np.add.at(wrong, pdf.step.to_numpy(), pdf.bad.to_numpy())
        each = delta / (strata * (top + 1))
        total, at, bound = int(good.sum()), None, 1.0
        for k in range(top, -1, -1):
            b = binomial_upper(int(good[k:].sum()), total, each)
            if b > alpha:
                break
            at, bound = k, b
        missed = int(wrong[:at].sum())
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], "n_good": [total], "n_bad": [int(wrong.sum())], "cutoff": [at / GRID if at is not None else None], "bound": [bound], "missed": [missed]})

    return hist.groupBy("stratum").applyInPandas(choose, "stratum string, n_good bigint, n_bad bigint, cutoff double, bound double, missed bigint")


def flag_repetitive(shares: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``shares`` with the cutoff of each row's stratum and ``flagged`` (share at or over it).

    Where a stratum has no certified cutoff that of all strata holds; without that either, nothing is flagged.
    """
    per = cutoffs.where(F.col("stratum") != ALL).select(F.col("stratum").alias("__s"), F.col("cutoff").alias("__own"))
    whole = cutoffs.where(F.col("stratum") == ALL).agg(F.max("cutoff").alias("__all"))  # one row
    out = shares.join(per, F.coalesce(F.col(stratum).cast("string"), F.lit("(null)")) == F.col("__s"), "left").join(F.broadcast(whole))
    out = out.withColumn("cutoff", F.coalesce("__own", "__all")).drop("__s", "__own", "__all")
    return out.withColumn("flagged", F.coalesce(F.col("share") >= F.col("cutoff"), F.lit(False)))
