import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.functions import conv
from loomline.operators import attempts, control, dedup, graph, manifests, publish, retrieval, reward, slots
from loomline.sources import fixture, jsonl, parquet


def test_secondary_choice_ignores_order(spark):
    ids = [(f"id-{k}",) for k in range(10)]
    a = slots.secondary(spark.createDataFrame(ids, "id string"), "id", 15).collect()
    b = slots.secondary(spark.createDataFrame(ids[::-1], "id string"), "id", 15).collect()
    assert len(a) == 5 and sorted(a) == sorted(b)
    for target in (9, 21):
        with pytest.raises(ValueError):
            slots.secondary(spark.createDataFrame(ids, "id string"), "id", target)
    with pytest.raises(ValueError):
        slots.secondary(spark.createDataFrame(ids + ids[:1], "id string"), "id", 15)


def test_assignment_counts(spark):
    df = slots.assign(spark.createDataFrame([(f"id-{k}",) for k in range(10)], "id string"), "id", 13)
    assert Counter(r.refinement_index for r in df.collect()) == {0: 10, 1: 3}


def test_numbered_is_gapless(spark):
    df = slots.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], 8)
    assert all(r.k == r.position for r in df.collect())
    wide = slots.numbered(spark.range(0, 200_000, 1, 7).select(F.sha2(F.col("id").cast("string"), 256).alias("h")), ["h"], 16).collect()
    assert [r.position for r in sorted(wide)] == list(range(200_000))
    odd = slots.numbered(spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("a", None)], "k string, v int"), ["k", "v"], 4).collect()
    assert [(r.k, r.v) for r in sorted(odd, key=lambda r: r.position)] == [(None, 1), (None, 3), ("a", None), ("a", 2)]
    assert slots.numbered(spark.range(0).select(F.col("id").alias("k")), ["k"]).count() == 0


def test_quotas(spark):
    got = slots.quotas(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t", 8).collect()
    assert sorted((r.t, r.n_variants) for r in got) == [("a", 3), ("b", 3), ("c", 2)]
    assert slots.quotas(spark.createDataFrame([], "t string"), "t", 8).count() == 0


def test_keep_first_and_collisions(spark):
    df = spark.createDataFrame([("x", 2, None), ("x", 1, "b"), (None, 5, "c"), ("x", 1, "b")], "k string, o int, v string")
    got = {(r.k, r.o, r.v) for r in dedup.keep_first(df, ["k"], ["o"]).collect()}
    assert got == {("x", 1, "b"), (None, 5, "c")}
    cand = spark.createDataFrame([("s2", "f"), ("s1", "f"), ("s3", "taken"), ("s4", None)], "synthetic_id string, fp string")
    have = spark.createDataFrame([("taken",), (None,)], "fp string")
    assert [r.synthetic_id for r in dedup.collision_winners(cand, have, "fp", "synthetic_id").where("won").collect()] == ["s1"]


def test_attempt_report(spark):
    rows = [("a", 1, "rejected", None, None, ["duplicate_conversation", "task_drift"]), ("a", 2, "accepted", None, None, []), ("b", 1, "provider_error", "HTTP 429", 0, None), ("b", 2, "provider_error", "x", 401, None)]
    df = spark.createDataFrame(rows, "synthetic_id string, attempt_number int, status string, error string, error_code int, rejection_codes array<string>")
    r = attempts.report(df, 4).first()
    assert (r.accepted_slots, r.acceptance_rate, r.n_attempts, r.n_collisions, r.n_fatal, r.n_transient) == (1, 0.25, 4, 1, 1, 1)
    assert {x.code: x.n for x in attempts.error_histogram(df).collect()} == {"unknown": 1, "401": 1}
    assert {x.code: x.n for x in attempts.rejection_histogram(df).collect()} == {"duplicate_conversation": 1, "task_drift": 1}


def test_publication(spark, tmp_path):
    src = fixture.conversations(spark, 4)
    ident = src.withColumns({"source_file": F.lit("f.parquet"), "source_row_index": F.split("run_id", "-")[1].cast("bigint"), "source_conversation_fingerprint": conv.fingerprint(F.col("conversations"))})
    ident = ident.withColumn("source_record_id", F.concat(F.lit("source-"), "source_row_index"))
    slot = slots.assign(ident.select("source_record_id"), "source_record_id", 6)
    turn = F.struct(F.col("synthetic_id").alias("content"), F.lit("user").alias("role"))
    answers = slot.select("synthetic_id", F.array(turn, F.struct(F.lit("done").alias("content"), F.lit("assistant").alias("role"))).alias("conversations"))
    refined = publish.refined_rows(slot, ident, answers, "m", "p", "policy")
    known = ident.select("source_record_id", "source_file", "source_row_index", F.col("trial_name").alias("source_trial_name"), "source_conversation_fingerprint", F.col("run_id").alias("source_run_id"), F.col("task").alias("source_task_id"))
    assert publish.lineage_violations(refined, known).count() == 0
    broken = refined.withColumn("task", F.lit("other")).withColumn("refined_conversation_fingerprint", F.lit("0"))
    assert {r.reason for r in publish.lineage_violations(broken, known).collect()} == {"task", "fingerprint"}
    assert {r.reason for r in publish.lineage_violations(refined.withColumn("source_record_id", F.lit("no")), known).collect()} >= {"unknown_source"}
    out = publish.union_published(src, refined)
    assert publish.same_schema(out.schema, publish.augmented_schema(src.schema))
    root, target = str(tmp_path / "pub"), str(tmp_path / "pub" / "publications" / "one")
    m = publish.write_publication(out, ["run_id"], 4, root, "one", {"policy": "policy"})
    assert [e["rows"] for e in m["shards"]] == [4, 4, 2] and os.path.exists(f"{target}/data/train-00002-of-00003.parquet")
    assert publish.write_publication(out, ["run_id"], 4, root, "one", {"policy": "policy"}) == m
    assert json.load(open(f"{root}/current.json"))["publication_id"] == "one"
    assert spark.read.parquet(f"{target}/data").where("NOT is_synthetic_augmentation").count() == 4
    for other in ({"policy": "another"}, {}):
        if other:
            with pytest.raises(ValueError, match="in the way"):
                publish.write_publication(out, ["run_id"], 4, root, "one", other)
    with pytest.raises(ValueError, match="changed between"):
        publish.write_publication(out, ["run_id"], 4, root, "two", unchanged=lambda: False)
    assert not os.path.exists(f"{root}/publications/two")
    with open(f"{target}/data/train-00000-of-00003.parquet", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        publish.verify_publication(spark, target)
    with pytest.raises(ValueError):
        publish.write_publication(out, ["run_id"], 4, root, "one", {"policy": "policy"})
    with pytest.raises(ValueError):
        publish.augmented_schema(out.schema)


def lineage_of(ident):
    return ident.select("source_record_id", "source_file", "source_row_index", F.col("trial_name").alias("source_trial_name"), "source_conversation_fingerprint", F.col("run_id").alias("source_run_id"), F.col("task").alias("source_task_id"))


def test_preflight_and_id(spark):
    src = fixture.conversations(spark, 4)
    ident = src.withColumns({"source_file": F.lit("f.parquet"), "source_row_index": F.split("run_id", "-")[1].cast("bigint"), "source_conversation_fingerprint": conv.fingerprint(F.col("conversations"))})
    ident = ident.withColumn("source_record_id", F.concat(F.lit("source-"), "source_row_index"))
    slot = slots.assign(ident.select("source_record_id"), "source_record_id", 6)
    turn = F.struct(F.col("synthetic_id").alias("content"), F.lit("user").alias("role"))
    answers = slot.select("synthetic_id", F.array(turn, F.struct(F.lit("done").alias("content"), F.lit("assistant").alias("role"))).alias("conversations"))
    refined, known = publish.refined_rows(slot, ident, answers, "m", "p", "v1").cache(), lineage_of(ident)
    found = lambda df: {r.check: r.n for r in df.collect()}
    assert found(publish.preflight(known, refined, 6, policy="v1", facts={"schema": ("a", "a")})) == {}
    assert found(publish.preflight(known, refined, 6, total_rows=11, policy="v2", facts={"schema": ("a", "b")})) == {"schema": 1, "total_rows": 1, "policy": 6}
    first = refined.where("refinement_index = 0")
    assert found(publish.preflight(known, first, 6)) == {"synthetic_rows": 2, "total_rows": 2, "missing_slots": 2}
    assert found(publish.preflight(known, first, 4)) == {}
    assert found(publish.preflight(known, refined.union(refined.limit(1)), 6)) == {"synthetic_rows": 1, "total_rows": 1, "repeated_id": 1, "repeated_fingerprint": 1}
    assert found(publish.preflight(known, refined, 9)) == {"synthetic_rows": 3, "total_rows": 3, "target": 1}
    other = refined.withColumn("run_id", F.concat(F.lit("x"), "run_id"))
    assert {"missing_slots": 6, "unknown_slots": 6}.items() <= found(publish.preflight(known, other, 6)).items()
    shards = spark.createDataFrame([("a", 1, "00")], "name string, bytes bigint, sha256 string")
    name = lambda acc, total=10, run="r", s=shards: publish.publication_id(known, acc, s, total, {"schema": "x"}, run, "v1")
    one = name(refined)
    assert one == name(refined.repartition(3)) and one.startswith("publication-") and len(one) == 32
    assert len({one, name(first), name(refined, 11), name(refined, 10, "q"), name(refined, s=shards.withColumn("sha256", F.lit("01")))}) == 5


def test_manifests_and_restore(spark, tmp_path):
    src = fixture.conversations(spark, 4)
    ident = lineage_of(src.withColumns({"source_file": F.lit("f"), "source_row_index": F.split("run_id", "-")[1].cast("bigint"), "source_conversation_fingerprint": F.lit("x")}).withColumn("source_record_id", F.concat(F.lit("source-"), "source_row_index")))
    source, state = str(tmp_path / "src"), str(tmp_path / "state")
    src.coalesce(1).write.parquet(source)
    body = manifests.ensure_source(spark, state, manifests.source_manifest(spark, source, ident, "asked"))
    assert manifests.ensure_source(spark, state, {**body, "requested_source": "otherwise"}) == body and len(body["files"]) == 1
    with pytest.raises(ValueError, match="rows"):
        manifests.ensure_source(spark, state, {**body, "rows": 5})
    run = manifests.ensure_run(spark, state, body, 6, "v1")
    assert manifests.ensure_run(spark, state, body, 6, "v1") == run
    with pytest.raises(ValueError, match="target_rows"):
        manifests.ensure_run(spark, state, body, 7, "v1")
    with pytest.raises(ValueError, match="twice"):
        manifests.ensure_run(spark, state, body, 9, "v1")
    facts = manifests.facts(body, run, 6, "v1", "asked")
    assert all(a == b for a, b in facts.values())
    assert {k for k, (a, b) in manifests.facts(body, run, 5, "v2", "no").items() if a != b} == {"source_name", "target_rows", "validation_policy"}
    manifests.verify_source(spark, body, ident)
    # state, sealing, restoring
    publish.write_shard(src.limit(2), "run_id", f"{state}/accepted")
    manifests.seal_state(spark, state)
    shard = publish.write_shard(src.orderBy(F.desc("run_id")).limit(1), "run_id", f"{state}/accepted")  # not sealed yet
    assert manifests.sealed_shards(spark, state)[1].count() == 2
    with pytest.raises(ValueError, match="unexpected"):
        manifests.verify_state(spark, state)
    os.remove(shard)
    got = manifests.restore(spark, state, str(tmp_path / "again"))
    assert got == {"run_instance_id": run["run_instance_id"], "accepted_rows": 2, "target_rows": 6, "pending_rows": 4, "shards": 1}
    with pytest.raises(FileExistsError):
        manifests.restore(spark, state, str(tmp_path / "again"))
    assert manifests.verify_remote(spark, state, str(tmp_path / "again"))["documents"]["run_manifest.json"] == run
    os.remove(tmp_path / "state" / "run_manifest.json")
    with pytest.raises(ValueError, match="run_manifest"):
        manifests.restore(spark, state, str(tmp_path / "third"))
    assert not (tmp_path / "third").exists()
    src.limit(1).write.mode("append").parquet(source)
    with pytest.raises(ValueError, match="differs from its manifest"):
        manifests.verify_source(spark, body, ident)
    calls = []

    def late():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "there"

    assert manifests.read_back(late, sleep=lambda s: None) == "there" and len(calls) == 3
    with pytest.raises(FileNotFoundError):
        manifests.read_back(lambda: open(tmp_path / "no"), tries=2, sleep=lambda s: None)


def test_invalid_answers_are_errors(spark):
    src = fixture.conversations(spark, 1)
    ident = src.withColumns({"source_file": F.lit("f"), "source_row_index": F.lit(0), "source_conversation_fingerprint": F.lit("x"), "source_record_id": F.lit("source-0")})
    slot = slots.assign(ident.select("source_record_id"), "source_record_id", 1)
    bad = slot.select("synthetic_id", F.lit(None).cast("array<struct<content:string,role:string>>").alias("conversations"))
    with pytest.raises(Exception, match="invalid conversation"):
        publish.refined_rows(slot, ident, bad, "m", "p", "v").collect()


def test_content_named_shard(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "run_id string, v int")
    path = publish.write_shard(df, "run_id", str(tmp_path))
    assert publish.write_shard(df, "run_id", str(tmp_path)) == path and len([n for n in os.listdir(tmp_path) if n[0] != '.']) == 1
    assert publish.write_shard(df.limit(0), "run_id", str(tmp_path)) is None
    with pytest.raises(ValueError, match="other rows"):
        publish.write_shard(df.withColumn("v", F.lit(9)), "run_id", str(tmp_path))


def test_single_file(spark, tmp_path):
    for n in (3, 2):
        publish.write_single(spark.range(n), str(tmp_path / "one.parquet"))
        assert os.path.isfile(tmp_path / "one.parquet") and spark.read.parquet(str(tmp_path / "one.parquet")).count() == n
    with pytest.raises(ValueError, match="10 to 50"):
        slots.pilot(spark.range(5), "id", 1, 9)


def test_control_documents(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("one")
    body = control.snapshot(str(src), str(tmp_path / "copy"))
    assert control.verify(str(tmp_path / "copy")) == body
    assert control.snapshot(str(src), str(tmp_path / "copy"))["digest"] == body["digest"]
    (tmp_path / "copy" / "b.txt").write_text("new")
    with pytest.raises(ValueError, match="unexpected"):
        control.verify(str(tmp_path / "copy"))
    os.remove(tmp_path / "copy" / "b.txt")
    (tmp_path / "copy" / "a.txt").write_text("two")
    with pytest.raises(ValueError, match="changed"):
        control.verify(str(tmp_path / "copy"))
    with pytest.raises(ValueError, match="missing"):
        control.inventory(str(src), {"gone": {"size": 0, "mtime_ns": 0, "sha256": ""}})
    with control.SingleWriter(str(tmp_path / "lock")), pytest.raises(RuntimeError), control.SingleWriter(str(tmp_path / "lock")):
        pass


def test_ordered_digest(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    assert control.ordered_digest(a, ["k", "v"], ["k"]) == control.ordered_digest(b, ["k", "v"], ["k"])
    assert control.ordered_digest(a, ["k", "v"], ["k"]) != control.ordered_digest(a.limit(1), ["k", "v"], ["k"])


def test_graph_examples(spark, tmp_path):
    ref = [{"source_name": "mitre-attack", "external_id": "T1"}]
    objs = [
        {"id": "t1", "type": "attack-pattern", "name": "Alpha", "description": " How. ", "external_references": ref, "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "initial-access"}], "x_mitre_platforms": ["Linux"], "x_mitre_detection": "Look.", "x_mitre_data_sources": ["Logs"]},
        {"id": "t2", "type": "attack-pattern", "name": "Gone", "description": "x", "external_references": ref, "revoked": True},
        {"id": "t3", "type": "attack-pattern", "name": "NoId", "description": "x"},
        {"id": "m1", "type": "course-of-action", "name": "Patch"},
        {"id": "g1", "type": "intrusion-set", "name": "Gang", "description": "Bad.", "aliases": ["G", "H"]},
        {"id": "s1", "type": "tool", "name": "Tool", "description": "Does."},
        {"id": "x1", "type": "x-mitre-tactic", "name": "Access", "description": "Enter."},
        {"id": "x2", "type": "x-mitre-tactic", "name": "Empty", "description": " "},
        {"id": "r1", "type": "relationship", "relationship_type": "mitigates", "source_ref": "m1", "target_ref": "t1"},
        {"id": "r2", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "t1"},
        {"id": "r3", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "t2"},
        {"id": "r4", "type": "relationship", "relationship_type": "uses", "source_ref": "g1", "target_ref": "s1"},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"objects": objs}, indent=1))
    got = {(r.id, r.kind): [m.content for m in r.messages] for r in graph.examples(graph.objects(spark, str(tmp_path / "b.json")), "sys").collect()}
    assert set(got) == {("t1", "explain"), ("t1", "detect"), ("t1", "json"), ("t1", "mitigate"), ("g1", "group"), ("g1", "uses"), ("s1", "software"), ("x1", "tactic")}
    assert got["t1", "explain"] == ["sys", "Explain the ATT&CK technique Alpha (T1).", "How.\n\n**Tactic(s):** Initial Access\n**Platforms:** Linux"]
    assert got["t1", "detect"][2] == "Look.\n**Data sources:** Logs" and got["t1", "mitigate"][2] == "- Patch"
    assert json.loads(got["t1", "json"][2])["recommended_mitigation"] == ["Patch"]
    assert got["g1", "uses"][2] == "- Alpha\n- Gone" and got["s1", "software"][2] == "Does.\n\n**Platforms:** various platforms"


def test_rewards(spark):
    rows = [("x Answer: 1,024", "1024"), ("Answer:7", "8"), ("none", "1"), ("w " * 50 + "Answer: 3", "3")]
    df = spark.createDataFrame(rows, "c string, a string")
    got = [(r[0], r[1], r[2], r[3]) for r in df.select(reward.answer(F.col("c")), reward.correctness(F.col("c"), F.col("a")), reward.form(F.col("c")), reward.reasoning(F.col("c"))).collect()]
    assert got == [("1024", 1.0, 0.2, 0.0), ("7", 0.0, 0.2, 0.0), ("", 0.0, 0.0, 0.0), ("3", 1.0, 0.2, 0.1)]


def test_top_k_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<float>").repartition(5)
    small = retrieval.top_k(df, df.where("id < 7"), "id", "id", "v", 4, most_bytes=200)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q, docs in small.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "doc")))["doc"]).collect():
        assert docs == list(np.argsort(-(n @ n[q]))[:4])
    assert retrieval.top_k(df, df.limit(0), "id", "id", "v", 3).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(1,), (3,), (None,), (11,)], "rank int")
    r = retrieval.metrics(df, "rank").first()
    assert (r.accuracy_at_1, r.recall_at_5, r.precision_at_5) == (0.25, 0.5, 0.1) and r.mrr_at_10 == round((1 + 1 / 3) / 4, 6)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('[]\n{"synthetic_id": "s", "agent_call_number": 4}\nnot-json\n{"synthetic_id": 5}\n{"synthetic_id": ""}\n\n{"synthetic_id": "s"}\n')
    counts, totals = jsonl.id_counts(spark, str(tmp_path / "a.jsonl"))
    assert [(r.synthetic_id, r.n) for r in counts.collect()] == [("s", 2)]
    t = totals.first()
    assert (t.n_lines, t.n_malformed, t.last_call) == (6, 4, 4)
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.strict(spark, str(tmp_path / "a.jsonl")).select("value").collect()
    (tmp_path / "b.jsonl").write_text('{"variant_id": "v", "status": "ok"}\n{"variant_id": "w", "status": "bad"}\n{')
    assert [r[0] for r in jsonl.completed(spark, str(tmp_path / "b.jsonl")).collect()] == ["v"]


def test_event_fold(spark):
    lines = ['{"type":"thread.started","thread_id":"t"}', '{"type":"item.completed","item":{"type":"agent_message","text":"one"}}', '{"type":"item.completed","item":{"type":"agent_message","text":"two"}}', '{"type":"turn.completed","usage":{"input":5,"bad":-1}}', '{"type":"error","message":"oops"}', "{"]
    df = spark.createDataFrame([("c", i, x) for i, x in enumerate(lines)], "call string, line int, value string")
    r = jsonl.fold_events(df, "call", "line").first()
    assert (r.message, r.thread_id, r.usage, r.errors, r.n_malformed) == ("two", "t", {"input": 5}, "oops", 1)


def test_parquet_sources(spark, tmp_path):
    fixture.conversations(spark, 5, partitions=2).write.parquet(str(tmp_path / "s"))
    files = parquet.resolve(str(tmp_path / "s"))
    assert parquet.footer_rows(files) == 5
    df = parquet.with_coordinates(parquet.read(spark, str(tmp_path / "s")), {os.path.basename(f): f"hub/{k}.parquet" for k, f in enumerate(files)})
    got = sorted((r.source_file, r.source_row_index) for r in df.collect())
    assert got == [("hub/0.parquet", 0), ("hub/0.parquet", 1), ("hub/1.parquet", 0), ("hub/1.parquet", 1), ("hub/1.parquet", 2)]
    spark.range(2).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="missing"):
        parquet.read(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        parquet.resolve(str(tmp_path / "none"))
