"""Verifiable rewards of completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import text as X


def answer(completion: Column) -> Column:
    """The number after ``Answer:``, without thousands separators; '' where there is none."""
    return F.replace(F.regexp_extract(completion, rf"Answer:{X.WS}*([0-9,]+)", 1), F.lit(","), F.lit(""))


def correctness(completion: Column, expected: Column) -> Column:
    return F.when(answer(completion) == expected, 1.0).otherwise(0.0)


def form(completion: Column) -> Column:
    return F.when(completion.rlike(rf"Answer:{X.WS}*[0-9]"), 0.2).otherwise(0.0)


def reasoning(completion: Column, words: int = 50) -> Column:
    """A little for at least ``words`` words before the first ``Answer:``."""
    before = F.get(F.split(completion, "Answer:"), F.lit(0))
    return F.when(F.size(F.filter(F.split(before, rf"{X.WS}+"), lambda w: w != "")) >= words, 0.1).otherwise(0.0)


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rewards against their group: (reward - mean) / standard deviation, 0 if all are equal."""
    w = W.partitionBy(group)
    sd = F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.when(sd > 1e-9, (F.col(reward) - F.avg(reward).over(w)) / sd).otherwise(0.0))
