from pyspark.sql import functions as F

from loomline.streaming import acceptor, attempts

TURN = "array<struct<content:string,role:string>>"


def test_acceptor_first_wins_across_batches(spark, tmp_path):
    talk = lambda x: [("ask " + x, "user"), ("answer " + x, "assistant")]
    first = [("s2", talk("one")), ("s1", talk("one")), ("s3", [("x", "user")])]
    second = [("s4", talk("one")), ("s2", talk("two")), ("s5", talk("two")), ("s1", talk("three"))]
    schema = f"synthetic_id string, conversations {TURN}"
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    for k in range(2):
        acceptor.commit(spark.read.parquet(str(tmp_path / f"in{k}")), k, folder)
        acceptor.commit(spark.read.parquet(str(tmp_path / f"in{k}")), k, folder)  # delivered again
    have = {r.synthetic_id: r.conversations[0].content for r in acceptor.accepted(spark, folder).collect()}
    assert have == {"s1": "ask one", "s2": "ask two"}


def test_windowed_counts_run(spark, tmp_path):
    df = spark.createDataFrame([("a", "accepted", 1)], "synthetic_id string, status string, attempt_number int").withColumn("logged_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = attempts.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 1


def test_a_new_checkpoint_drops_nothing(spark, tmp_path):
    talk = lambda x: [(x, "user"), ("done", "assistant")]
    kind = "synthetic_id string, conversations array<struct<content:string,role:string>>"
    folder = str(tmp_path / "accepted")
    for k, rows in enumerate(([("a", talk("one"))], [("a", talk("one")), ("b", talk("two"))])):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / f"in{k}"))
        acceptor.run(stream, folder, str(tmp_path / f"check{k}"))  # batch numbers start at 0 again
    assert sorted(r.synthetic_id for r in acceptor.accepted(spark, folder).collect()) == ["a", "b"]
