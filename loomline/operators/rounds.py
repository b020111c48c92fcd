"""Rounds of generation with a generator that is handed in: bounded batches, retries, attempt log, collisions, progress.

The folder of a run is its state, on any storage:

    accepted/round-NNNNNN-<token>/   synthetic_id, conversations, fingerprint of the slots accepted in a round
    attempts/round-NNNNNN-<token>/   one record an attempt
    progress.json                    where the run stands, replaced after each round; a snapshot, the folders decide

Both folders only ever get new parts.

A round takes slots without an accepted conversation, those already tried before new ones, asks the generator once for each,
judges the answers, resolves collisions against everything accepted, and commits the attempts after the accepted rows. If a round
breaks off between the two, its accepted rows stand and its attempts are not counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import conv
from loomline.functions.session import cut
from loomline.functions.storage import Storage, document
from loomline.operators import attempts as A
from loomline.operators.dedup import collision_winners
from loomline.streaming.acceptor import ACCEPTED

SLOT = ["synthetic_id", "source_record_id", "source_file", "source_row_index", "source_trial_name", "source_conversation_fingerprint", "source_run_id", "source_task_id", "refinement_index"]
ATTEMPT = (
    "synthetic_id string, source_record_id string, source_file string, source_row_index bigint, source_trial_name string, source_conversation_fingerprint string, source_run_id string, source_task_id string, refinement_index tinyint, "
    "attempt_number int, status string, error string, error_code int, conversation_fingerprint string, interaction_id string, provider_request_number bigint, rejection_codes array<string>, validation_policy string"
)


def attempt_record(answers: DataFrame, policy: str) -> DataFrame:
    """The record of each attempt with all its 18 fields; columns ``answers`` lacks are null, no codes are an empty list."""
    fields = [f.strip().split(" ") for f in ATTEMPT.split(", ")]
    cols = [F.col(n).cast(t).alias(n) if n in answers.columns else F.lit(None).cast(t).alias(n) for n, t in fields if n not in ("rejection_codes", "validation_policy")]
    codes = F.coalesce(F.col("rejection_codes"), F.array().cast("array<string>")) if "rejection_codes" in answers.columns else F.array().cast("array<string>")
    return answers.select(*cols, codes.alias("rejection_codes"), F.lit(policy).alias("validation_policy"))


class Run:
    """A run over a fixed set of slots (see the module's text)."""

    def __init__(self, spark: SparkSession, folder: str, slots: DataFrame, policy: str = "v1"):
        self.spark, self.folder, self.slots, self.policy, self.files = spark, folder.rstrip("/"), slots, policy, Storage(spark, folder)

    def _read(self, what: str, schema) -> DataFrame:
        done = [f"{self.folder}/{what}/{n}" for n in self.files.names(f"{self.folder}/{what}")]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def accepted(self) -> DataFrame:
        return self._read("accepted", ACCEPTED)

    def attempts(self) -> DataFrame:
        return self._read("attempts", ATTEMPT)

    def progress(self) -> dict:
        """The snapshot written last."""
        path = f"{self.folder}/progress.json"
        return self.files.json(path) if self.files.exists(path) else {**self.counted(), "stopped": None}

    def counted(self) -> dict:
        """Rounds, requests and accepted slots as the folders have them."""
        rounds_ = [int(n.split("-")[1]) for n in self.files.names(f"{self.folder}/attempts")]
        return {"rounds": max(rounds_, default=0), "requests": self.attempts().count(), "accepted": self.accepted().count()}

    def due(self, most_attempts: int) -> DataFrame:
        """Slots to ask for: not accepted, fewer than ``most_attempts`` attempts; with the number of the next attempt."""
        tried = self.attempts().groupBy("synthetic_id").agg(F.max("attempt_number").alias("_tried"))
        open_ = self.slots.select(*SLOT).join(self.accepted().select("synthetic_id"), "synthetic_id", "left_anti").join(tried, "synthetic_id", "left")
        return open_.withColumn("attempt_number", F.coalesce("_tried", F.lit(0)) + 1).where(F.col("attempt_number") <= most_attempts).drop("_tried")

    def round(self, generate: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], Column], batch: int, most_attempts: int, budget: int | None = None, secret: str = "") -> dict:
        """One round of at most ``batch`` requests; gives the progress.

        ``generate``: a pure function of slots with attempt_number that adds conversations, error, error_code and interaction_id;
        ``judge``: the list of codes of an answer. A null conversation without an error is rejected as ``invalid_json``.
        """
        now = self.counted()
        left = batch if budget is None else min(batch, budget - now["requests"])
        if left <= 0:
            return self._stop(now, "budget")
        part = f"round-{now['rounds'] + 1:06d}-{uuid.uuid4().hex}"
        # retries come before new work
        asked = cut(self.due(most_attempts).orderBy(F.col("attempt_number") == 1, "attempt_number", "synthetic_id").limit(left))
        if asked.isEmpty():
            return self._stop(now, "done")
        answers = cut(generate(asked))
        failed = F.col("error").isNotNull() | F.col("error_code").isNotNull()
        codes = F.when(failed, F.array().cast("array<string>")).when(F.col("conversations").isNull(), F.array(F.lit("invalid_json"))).otherwise(judge(answers))
        rows = answers.withColumns({"_failed": failed, "rejection_codes": codes, "fingerprint": F.when(~failed & F.col("conversations").isNotNull(), conv.fingerprint(F.col("conversations")))})
        good = rows.where(~F.col("_failed") & (F.size("rejection_codes") == 0))
        won = cut(collision_winners(good.select(*ACCEPTED.names), self.accepted(), "fingerprint", "synthetic_id").where("won").select(*ACCEPTED.names))
        if not won.isEmpty():
            won.write.parquet(f"{self.folder}/accepted/{part}")
        rows = rows.join(won.select("synthetic_id", F.lit(True).alias("_won")), "synthetic_id", "left")
        lost = ~F.col("_failed") & (F.size("rejection_codes") == 0) & F.col("_won").isNull()
        status = F.when(F.col("_failed"), "provider_error").when(F.col("_won"), "accepted").otherwise("rejected")
        error = F.when(F.col("_failed"), A.safe_error(F.coalesce("error", F.lit("")), secret)).when(lost, "duplicate_conversation").when(F.size("rejection_codes") > 0, F.array_join("rejection_codes", "; "))
        order = F.row_number().over(_by_id()) + F.lit(now["requests"])
        record = rows.withColumns({"status": status, "error": error, "rejection_codes": F.when(lost, F.array(F.lit("duplicate_conversation"))).otherwise(F.col("rejection_codes")), "conversation_fingerprint": F.col("fingerprint"), "provider_request_number": order})
        attempt_record(record, self.policy).write.parquet(f"{self.folder}/attempts/{part}")
        sound = self.spark.read.schema(ATTEMPT).parquet(f"{self.folder}/attempts/{part}").where(F.col("error_code").isin(*A.FATAL)).isEmpty()
        body = {**self.counted(), "stopped": None if sound else "fatal"}
        self.files.write(f"{self.folder}/progress.json", document(body))
        return body

    def _stop(self, now: dict, why: str) -> dict:
        body = {**now, "stopped": why}
        self.files.write(f"{self.folder}/progress.json", document(body))
        return body

    def until(self, generate: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], Column], batch: int, most_attempts: int = 3, budget: int | None = None, target: int | None = None, idle: int = 3, secret: str = "") -> dict:
        """Rounds until the target is reached, nothing is due, the budget is spent, a fatal error came, or ``idle`` rounds accepted nothing."""
        dry, last = 0, {**self.counted(), "stopped": None}
        while target is None or last["accepted"] < target:
            now = self.round(generate, judge, batch, most_attempts, budget, secret)
            if now["stopped"]:
                return now
            dry = dry + 1 if now["accepted"] == last["accepted"] else 0
            if dry >= idle:
                return self._stop(now, "none_accepted")
            last = now
        return self._stop(last, "target")


def _by_id():
    from pyspark.sql import Window as W

    return W.orderBy("synthetic_id")  # one bounded batch


def sample_pairs(accepted: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` accepted rows by run_id with the conversation of their source; an unknown source is an error when read.

    ``accepted``: run_id, source_record_id, conversations; ``sources``: source_record_id, conversations.
    """
    first = accepted.select(F.col("run_id").alias("synthetic_id"), "source_record_id", F.col("conversations").alias("refined_conversations")).orderBy("synthetic_id").limit(most)
    both = first.join(sources.select("source_record_id", F.col("conversations").alias("_source"), F.lit(True).alias("_known")), "source_record_id", "left")
    bad = F.raise_error(F.concat(F.lit("unknown source record: "), F.coalesce("source_record_id", F.lit("null")))).cast(sources.schema["conversations"].dataType)
    return both.select("synthetic_id", "source_record_id", F.when(F.col("_known"), F.col("_source")).otherwise(bad).alias("source_conversations"), "refined_conversations")
