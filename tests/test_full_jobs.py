"""What the queries must hold beyond their SQL."""

from pyspark.sql import functions as F

from loomline.plans import attempt_queries as A
from loomline.plans import slot_queries as S

D = "/root/testdata/sf0.001"


def test_no_fingerprint_of_another_slot_is_won(spark):
    have = spark.read.parquet(f"{D}/refined_rows.parquet").select(F.col("run_id").alias("other"), F.lower("refined_conversation_fingerprint").alias("fingerprint")).distinct()
    won = A.dedup_collision_winner(spark, D).where("won")
    assert won.join(have, "fingerprint").where("other != synthetic_id").count() == 0 and won.count() > 0


def test_codes_count_lost_anchors(spark):
    full, plain = ({x.run_id: x.codes for x in f(spark, D).collect()} for f in (S.quality_codes, S.quality_codes_plain))
    assert sum("task_drift" in x for x in full.values()) > sum("task_drift" in x for x in plain.values())
    codes = [c for x in full.values() for c in x.split(",") if c]
    assert {x.code: x.n for x in S.quality_code_histogram(spark, D).collect()} == {c: codes.count(c) for c in codes}


def test_details_belong_to_codes(spark):
    full = {x.run_id: x.codes for x in S.quality_codes(spark, D).collect()}
    for x in S.quality_issue_details(spark, D).collect():
        found = [c for c in full[x.run_id].split(",") if c]
        assert all(f"{c}: " in x.error for c in found) and bool(found) == bool(x.error)
