import pytest
from pyspark.sql import functions as F

from loomline.operators import quality

TURNS = "array<struct<content:string,role:string>>"
ASK = "Write the inventory report for the northern warehouse into reports/north.csv today"
GOOD = [(ASK, "user"), ("I wrote the inventory report for the northern warehouse to reports/north.csv with all rows.", "assistant")]


def codes(spark, source, candidate, f=quality.codes):
    return spark.createDataFrame([(source, candidate)], f"s {TURNS}, c {TURNS}").select(f(F.col("s"), F.col("c")).alias("x")).first().x


def test_clean(spark):
    other = [(ASK + " please", "user"), GOOD[1]]
    assert codes(spark, GOOD, other) == []


@pytest.mark.parametrize(
    "candidate, code",
    [
        ([(ASK, "user"), (ASK + " again", "user")], "missing_participant"),
        ([*GOOD, ("and now?", "user")], "invalid_turn_order"),
        ([(ASK, "user"), ("out", "tool"), GOOD[1]], "orphan_tool"),
        ([(ASK, "user"), ("I'm sorry, I cannot help with the inventory report northern warehouse", "assistant")], "refusal_only"),
        ([(ASK, "user"), (ASK, "assistant")], "degenerate_content"),
        ([("Paint my kitchen walls blue and white", "user"), ("The kitchen walls are blue and white now.", "assistant")], "task_drift"),
        (GOOD, "unchanged_conversation"),
    ],
)
def test_codes(spark, candidate, code):
    assert code in codes(spark, GOOD, candidate)


def test_tool_runs_between_assistants_are_fine(spark):
    run = [(ASK, "user"), ("Checking the inventory report northern warehouse.", "assistant"), ("one", "tool"), ("two", "tool"), GOOD[1]]
    assert codes(spark, GOOD, run) == []


def test_invalid_forms_come_alone(spark):
    assert codes(spark, GOOD, [("x", "user")]) == ["invalid_conversation"]
    assert codes(spark, GOOD, None) == ["invalid_conversation"]
    assert codes(spark, GOOD, [(None, "user"), ("x", "assistant")]) == ["invalid_conversation"]


def test_secondary(spark):
    src = [(ASK, "user"), ("a", "assistant"), ("out", "tool"), ("done", "assistant")]
    cand = [("Summarize it", "user"), ("more", "user"), ("The task is complete", "assistant")]
    assert codes(spark, src, cand, quality.secondary_codes) == ["adjacent_same_role", "missing_tool_evidence", "added_deliverable", "vague_completion"]
    assert codes(spark, GOOD, GOOD, quality.secondary_codes) == []
