"""Attempt counts and first successes over a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts(attempts: DataFrame) -> DataFrame:
    """Attempts per slot so far (for ``complete`` or ``update`` output)."""
    return attempts.where("synthetic_id IS NOT NULL").groupBy("synthetic_id").agg(F.count("*").alias("n_attempts"), F.max("attempt_number").alias("last_attempt"))


def windowed(attempts: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Attempts per hour and status; rows later than the watermark are left out."""
    return attempts.withWatermark("logged_at", late).groupBy(F.window("logged_at", width), "status").agg(F.count("*").alias("n"))


def first_success(attempts: DataFrame) -> DataFrame:
    """Each slot once, when its first accepted attempt arrives: (synthetic_id, attempt_number, seen).

    ``seen`` counts the attempts up to then in order of arrival. The state of a slot is two numbers.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else (0, 0)
        for pdf in batches:
            won = (pdf.status == "accepted").to_numpy()
            if not done and won.any():
                at = int(won.argmax())
                done = 1
                yield pd.DataFrame({"synthetic_id": [key[0]], "attempt_number": [pdf.attempt_number.iloc[at]], "seen": [seen + at + 1]})
            seen += len(pdf)
        state.update((seen, done))

    rows = attempts.where("synthetic_id IS NOT NULL").select("synthetic_id", "status", "attempt_number")
    return rows.groupBy("synthetic_id").applyInPandasWithState(fold, "synthetic_id string, attempt_number int, seen bigint", "seen bigint, done int", "append", GroupStateTimeout.NoTimeout)
