import pytest
from pyspark.sql import functions as F

from loomline.operators.incremental import VersionedTarget, changed, due_shards
from loomline.streaming import checkpoints

INV = "run_instance_id string, snapshot_seq int, path string, sha256 string, extra string"
MAN = "run_instance_id string, checkpoint string, completed_rows bigint, path string, sha256 string"
STA = "run_instance_id string, status string, last_checkpoint string"
P = lambda k: f"accepted/accepted-{k:020x}.parquet"


def due(spark, inv, man, sta):
    got = due_shards(spark.createDataFrame(inv, INV), spark.createDataFrame(man, MAN), spark.createDataFrame(sta, STA))
    return sorted((r.run_instance_id, r.path) for r in got.collect())


def test_new_changed_and_done(spark):
    inv = [("r", 1, P(1), "aa", None), ("r", 2, P(1), "bb", None), ("r", 1, P(2).replace("/", "\\"), "CC", "x"), ("r", 1, "./" + P(2), "cc", None), ("r", 3, P(3), "dd", None), ("r", 3, P(3), "dd", None)]
    man = [("r", "c1", 10, P(1), "aa"), ("r", "c1", 10, P(2), "cc"), ("r", "c2", 20, P(3), "dd"), ("q", "c2", 20, P(3), "dd")]
    sta = [("r", "synchronized", "c1"), ("r", "failed", "c2"), ("q", "synchronized", "c2"), ("r", "synchronized", None)]
    assert due(spark, inv, man, sta) == [("r", P(1)), ("r", P(3))]


def test_highest_rows_win_and_sealed_back(spark):
    inv = [("r", 1, P(1), "aa", None), ("r", 2, P(1), "bb", None), ("r", 3, P(1), "aa", None)]
    man = [("r", "c1", 10, P(1), "aa"), ("r", "c2", 20, P(1), "bb")]
    sta = [("r", "synchronized", "c1"), ("r", "synchronized", "c2")]
    assert due(spark, inv, man, sta) == [("r", P(1))]


def test_empty_and_null(spark):
    assert due(spark, [], [], []) == []
    inv = [("r", 1, P(1), "aa", None), (None, 1, P(1), "aa", None), ("r", 1, None, "aa", None), ("r", 1, P(2), None, None), ("r", None, P(4), "ee", None), ("r", 1, "odd name", "ff", None)]
    assert due(spark, inv, [], []) == [("r", P(1)), ("r", P(4))]


def test_null_versions_are_values(spark):
    src = spark.createDataFrame([("a", None), ("b", "1")], "k string, v string")
    tgt = spark.createDataFrame([("a", None), ("b", None)], "k string, v string")
    assert [r.k for r in changed(src, tgt, ["k"], "v").collect()] == ["b"]


def target_rows(t):
    return sorted((r["_source_key"], r["_source_version"], r.x) for r in t.read().collect())


def test_failures_neither_skip_nor_repeat(spark, tmp_path):
    t = VersionedTarget(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "k string, v string, x int")
    go = lambda df, **k: t.run(df, F.col("k"), F.col("v"), lambda d: d.withColumn("x", F.col("x") * 10), **k)

    def break_at(step):
        def fail(s):
            if s == step:
                raise RuntimeError(step)

        return fail

    for step in ("start", "written"):
        with pytest.raises(RuntimeError):
            go(one, fail=break_at(step))
        assert t.read() is None
    with pytest.raises(RuntimeError):
        go(one, fail=break_at("published"))
    assert target_rows(t) == [("a", "1", 10), ("b", "1", 20)]
    assert go(one) == 1
    two = spark.createDataFrame([("a", "2", 3), ("b", "1", 2), ("c", None, 4)], "k string, v string, x int")
    assert go(two) == 2 and go(two) == 2
    assert target_rows(t)[0] == ("a", "1", 10) and t.read().count() == 4
    assert sorted((r["_source_key"], r.x) for r in t.rows().collect()) == [("a", 30), ("b", 20), ("c", 40)]
    assert go(spark.createDataFrame([("a", "1", 9)], "k string, v string, x int")) == 3  # back to an older version


def test_two_writers(spark, tmp_path):
    t = VersionedTarget(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([("a", "1")], "k string, v string")

    def other(step):
        if step == "written":
            VersionedTarget(spark, str(tmp_path / "t")).run(one, F.col("k"), F.col("v"), lambda d: d)

    with pytest.raises(FileExistsError):
        t.run(one, F.col("k"), F.col("v"), lambda d: d, other)
    assert t.read().count() == 1


def test_null_keys_are_errors(spark, tmp_path):
    t = VersionedTarget(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="null source key"):
        t.run(spark.createDataFrame([(None, "1")], "k string, v string"), F.col("k"), F.col("v"), lambda d: d)


def test_threshold_checkpoints(spark, tmp_path):
    src, remote = tmp_path / "s", str(tmp_path / "r")
    src.mkdir()
    (src / "a").write_text("1")
    shards = {"a": {"size": 1, "sha256": "x"}}
    go = lambda rows, **k: checkpoints.checkpoint(spark, shards, rows, 10, str(src), remote, **k)
    assert go(9)["threshold"] == 0

    def fail(step):
        if step == "marker":
            raise RuntimeError

    with pytest.raises(RuntimeError):
        go(12, fail=fail)
    assert go(12)["threshold"] == 10 and go(19)["threshold"] == 10
    (src / "b").write_text("2")
    shards["b"] = {"size": 1, "sha256": "y"}
    assert go(25)["threshold"] == 20 and sorted(x.name for x in (tmp_path / "r" / "data").iterdir() if x.name[0] != ".") == ["a", "b"]
    del shards["a"]
    with pytest.raises(ValueError):
        go(40)


def test_records_without_rows_and_compaction(spark, tmp_path):
    t = VersionedTarget(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "k string, v string, x int")
    none = lambda d: d.where("k = 'a'")
    go = lambda df, f: t.run(df, F.col("k"), F.col("v"), f)
    assert go(df, none) == 1 and go(df, none) == 1  # b gave no rows, yet it is processed
    two = df.withColumn("v", F.lit("2"))
    assert go(two, lambda d: d.where("k = 'b'")) == 2
    assert sorted((r["_source_key"], r["_source_version"]) for r in t.rows().collect()) == [("b", "2")]  # a's last processing gave none
    before = target_rows(t)
    assert t.compact() == 3 and t.compact() == 3 and target_rows(t) == before
    assert sorted((r["_source_key"], r["_source_version"]) for r in t.rows().collect()) == [("b", "2")]
    assert go(two, none) == 3
