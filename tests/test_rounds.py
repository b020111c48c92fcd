import pytest
from pyspark.sql import functions as F

from loomline.functions import conv
from loomline.operators import quality, rounds
from loomline.streaming.acceptor import ACCEPTED  # noqa: F401

SLOTS = ", ".join(f"{c} {t}" for c, t in zip(rounds.SLOT, ("string", "string", "string", "bigint", "string", "string", "string", "string", "int")))


def slots_of(spark, ids):
    return spark.createDataFrame([(i, f"src-{i}", "f", 0, "t", "fp", "r", "task", 0) for i in ids], SLOTS)


def answers(asked, content, error=None, code=None):
    turn = lambda c, r: F.struct(c.alias("content"), F.lit(r).alias("role"))
    talk = F.array(turn(F.lit("ask"), "user"), turn(content, "assistant"))
    err = F.lit(None).cast("string") if error is None else error
    return asked.withColumns({"conversations": F.when(err.isNull(), talk), "error": err, "error_code": F.lit(None).cast("int") if code is None else code, "interaction_id": F.lit("x")})


def judge(rows):
    return F.array_compact(F.array(conv.problem(F.col("conversations"))))


def test_retries_collisions_and_progress(spark, tmp_path):
    run = rounds.Run(spark, str(tmp_path / "run"), slots_of(spark, ["a", "b", "c", "d", "e"]))
    seen = []

    def generate(asked):
        seen.append([(r.synthetic_id, r.attempt_number) for r in asked.orderBy("synthetic_id").collect()])
        # a and b say the same at first; c fails once with the secret in its error; d is never valid
        content = F.when(F.col("synthetic_id").isin("a", "b") & (F.col("attempt_number") == 1), "same").when(F.col("synthetic_id") == "d", " ").otherwise(F.concat("synthetic_id", F.col("attempt_number").cast("string")))
        error = F.when((F.col("synthetic_id") == "c") & (F.col("attempt_number") == 1), "key K-1 is busy")
        return answers(asked, content, error, F.when(error.isNotNull(), 503))

    first = run.round(generate, judge, 3, 2, secret="K-1")
    assert first == {"rounds": 1, "requests": 3, "accepted": 1, "stopped": None}
    # retries come before new work
    run.round(generate, judge, 3, 2)
    assert seen[0] == [("a", 1), ("b", 1), ("c", 1)] and seen[1] == [("b", 2), ("c", 2), ("d", 1)]
    last = run.until(generate, judge, 3, most_attempts=2)
    assert last["stopped"] == "done" and last["accepted"] == 4 and run.progress() == last
    assert {r.synthetic_id for r in run.accepted().collect()} == {"a", "b", "c", "e"}
    log = {(r.synthetic_id, r.attempt_number): r for r in run.attempts().collect()}
    assert log["b", 1].rejection_codes == ["duplicate_conversation"] and log["b", 1].status == "rejected"
    assert log["c", 1].status == "provider_error" and log["c", 1].error == "key [REDACTED] is busy" and log["c", 1].error_code == 503
    assert log["d", 2].rejection_codes == ["blank"] and len(log) == last["requests"]
    assert sorted(r.provider_request_number for r in log.values()) == list(range(1, last["requests"] + 1))
    assert len(run.attempts().columns) == 18


def test_stops(spark, tmp_path):
    ok = lambda asked: answers(asked, F.col("synthetic_id"))
    bad = lambda asked: answers(asked, F.lit("x"), F.lit("no"), F.lit(401))
    busy = lambda asked: answers(asked, F.lit("x"), F.lit("no"), F.lit(503))
    go = lambda name, gen, **k: rounds.Run(spark, str(tmp_path / name), slots_of(spark, ["a", "b", "c"])).until(gen, judge, 1, **k)
    assert go("fatal", bad)["stopped"] == "fatal"
    assert go("idle", busy, most_attempts=9, idle=2) == {"rounds": 2, "requests": 2, "accepted": 0, "stopped": "none_accepted"}
    assert go("budget", ok, budget=2) == {"rounds": 2, "requests": 2, "accepted": 2, "stopped": "budget"}
    assert go("budget", ok, budget=3)["accepted"] == 3  # goes on where it stopped
    assert go("target", ok, target=1)["stopped"] == "target"
    assert go("none", ok, most_attempts=0)["stopped"] == "done"


def test_half_committed_round(spark, tmp_path):
    run = rounds.Run(spark, str(tmp_path / "run"), slots_of(spark, ["a", "b"]))

    def broken(asked):
        return answers(asked, F.col("synthetic_id"))

    real = rounds.attempt_record
    rounds.attempt_record = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError):
            run.round(broken, judge, 1, 3)
    finally:
        rounds.attempt_record = real
    assert [r.synthetic_id for r in run.accepted().collect()] == ["a"] and run.attempts().count() == 0
    asked = []
    run.until(lambda x: asked.append([r.synthetic_id for r in x.collect()]) or broken(x), judge, 5)
    assert asked == [["b"]]  # what was accepted stands and is not asked for again
    assert sorted(r.synthetic_id for r in run.accepted().collect()) == ["a", "b"]
    assert run.progress() == {"rounds": 1, "requests": 1, "accepted": 2, "stopped": "done"}


def test_sample_pairs(spark):
    talk = "array<struct<content:string,role:string>>"
    acc = spark.createDataFrame([("r2", "s1", [("b", "user")]), ("r1", "s2", [("a", "user")])], f"run_id string, source_record_id string, conversations {talk}")
    src = spark.createDataFrame([("s1", [("x", "user")]), ("s2", [("y", "user")])], f"source_record_id string, conversations {talk}")
    got = rounds.sample_pairs(acc, src, 1).collect()
    assert [(r.synthetic_id, r.source_conversations[0].content, r.refined_conversations[0].content) for r in got] == [("r1", "y", "a")]
    with pytest.raises(Exception, match="unknown source record: s1"):
        rounds.sample_pairs(acc, src.where("source_record_id = 's2'")).collect()


ASK = "Write the inventory report for the northern warehouse into reports/north.csv today"
DONE = "I wrote the inventory report for the northern warehouse to reports/north.csv with all rows."


@pytest.mark.parametrize(
    "candidate, want",
    [
        ([(ASK + " please", "user"), (DONE, "assistant")], {}),
        ([(ASK, "user"), ("out", "tool"), ("more", "tool"), (DONE, "assistant")], {"orphan_tool": "tool block beginning near turn 1 has no assistant invocation; tool block beginning near turn 2 has no assistant invocation"}),
        ([(ASK, "user"), (DONE, "assistant"), ("out", "tool")], {"invalid_turn_order": "candidate must end with an assistant interpretation or summary", "orphan_tool": "tool block ending near turn 2 has no assistant interpretation"}),
        ([(ASK, "user"), (ASK.upper(), "assistant")], {"degenerate_content": "candidate repeats adjacent turn content"}),
        ([("Paint my kitchen walls blue", "user"), ("The kitchen walls are blue now.", "assistant")], {"task_drift": "source-task token retention 0.000 is below policy; assistant/tool task-token retention 0.000 is below policy; candidate loses every required high-signal task anchor"}),
        ([(ASK, "user"), (DONE, "assistant")], {"unchanged_conversation": "refined conversation is identical to the source conversation"}),
        ([("x", "user")], {"invalid_conversation": ""}),
    ],
)
def test_issue_details(spark, candidate, want):
    turns = "array<struct<content:string,role:string>>"
    source = [(ASK, "user"), (DONE, "assistant")]
    row = spark.createDataFrame([(source, candidate)], f"s {turns}, c {turns}")
    got = row.select(quality.issues(F.col("s"), F.col("c")).alias("i"), quality.codes(F.col("s"), F.col("c")).alias("k"), quality.error_text(quality.issues(F.col("s"), F.col("c"))).alias("e")).first()
    assert {x.code: x.detail for x in got.i} == want and [x.code for x in got.i] == got.k
    assert got.e == "; ".join(f"{k}: {v}" for k, v in want.items())
