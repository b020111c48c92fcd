import hashlib
import json
import random

from pyspark.sql import functions as F

from loomline.functions import conv, identity
from loomline.functions import text as X

TURNS = "array<struct<content:string,role:string>>"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def python_json(turns):
    return json.dumps([{"content": c or "", "role": r} for c, r in turns], ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_json_escape_equals_python(spark):
    r = random.Random(1)
    odd = [chr(i) for i in range(32)] + list('"\\/\u007f é€😀') + ["\\u001B"]
    texts = ["".join(r.choice(odd) for _ in range(30)) for _ in range(40)] + ["", "plain", "\x1b[0m"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.json_escape(F.col("x")).alias("y")).collect()
    assert all(r.y == json.dumps(r.x, ensure_ascii=False)[1:-1] for r in rows)


def test_fingerprint_equals_python(spark):
    turns = [("a\nb\x1b", "user"), (None, "assistant"), ('q"\\', "tool")]
    got = one(spark, turns, conv.fingerprint, TURNS)
    assert got == hashlib.sha256(python_json(turns).encode()).hexdigest()


def test_strip_and_squeeze_take_all_white_space(spark):
    s = "  \x1c a  b　 "
    assert one(spark, s, X.strip) == s.strip()
    assert one(spark, s, X.squeeze) == " ".join(s.split())
    assert one(spark, None, X.strip) is None


def test_problems(spark):
    ok = [("hi", "user"), ("yes", "assistant")]
    cases = [(ok, None), ([("hi", "user")], "turns"), ([("hi", "bot"), ("x", "assistant")], "role"), ([(None, "user"), ("x", "assistant")], "content"), ([("  ", "user"), ("x", "assistant")], "blank"), (ok + [("more", "user")], "final"), ([("x", "assistant")] * 41, "turns"), (None, "turns")]
    for turns, want in cases:
        assert one(spark, turns, conv.problem, TURNS) == want


def test_legacy_form(spark):
    turns = [(" A \n b", "user"), (None, "observation")]
    got = one(spark, turns, conv.legacy_normal, TURNS)
    assert [(t.content, t.role) for t in got] == [("A \n b", "user"), ("", "tool")]
    assert one(spark, [("x", "robot")], conv.legacy_normal, TURNS) is None
    a = one(spark, [("Hello  World", "user")], conv.legacy_fingerprint, TURNS)
    assert a == one(spark, [(" hello world ", "assistant")], conv.legacy_fingerprint, TURNS) == hashlib.sha256(b"hello world").hexdigest()


def test_instruction(spark):
    text = "Intro\nTask Description:\n do it \n\nCurrent terminal state:\n$"
    assert one(spark, [(text, "user")], conv.instruction, TURNS) == "do it"
    assert one(spark, [("Task Description:\n all", "user")], conv.instruction, TURNS) == "all"
    for turns in ([], None, [(text, "assistant")], [(None, "user")], [("nothing", "user")]):
        assert one(spark, turns, conv.instruction, TURNS) == ""


def test_ids(spark):
    row = spark.range(1).select(
        identity.synthetic_id(F.lit("source-1"), F.lit(1)).alias("s"), identity.attempt_seed(F.lit("x"), F.lit(3)).alias("a"), identity.variant_id(F.lit("t-v1-x"), F.lit(0)).alias("v"),
        identity.task_of_variant(identity.variant_id(F.lit("t-v1-x"), F.lit(0))).alias("t"), identity.synthetic_id(F.lit(None).cast("string"), F.lit(0)).alias("n"),
        identity.source_record_id(F.lit("f"), F.lit(7), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("r"),
    ).first()
    assert row.s == "refined-" + hashlib.sha256(b"refinement\0source-1\x001").hexdigest()[:24]
    assert row.a == int.from_bytes(hashlib.sha256(b"x\0attempt\x003").digest()[:4], "big") & 0x7FFFFFFF
    assert row.v == "t-v1-x-v0-" + hashlib.sha256(b"t-v1-x::0").hexdigest()[:16]
    assert row.t == "t-v1-x" and row.n is None
    assert row.r == "source-" + hashlib.sha256(b"source-row\0f\x007\0a\0b\0c\0d").hexdigest()[:24]


def test_tokens_and_anchors(spark):
    s = "Please use `Foo bar` and /etc/hosts.conf with --dry-run 12.5 at https://x.y/z. The the iPhone"
    assert set(one(spark, s, X.tokens)) == {"foo", "bar", "etc/hosts.conf", "dry-run", "12.5", "https://x.y/z", "iphone"}
    found = set(one(spark, s, X.anchors))
    assert {"foo bar", "/etc/hosts.conf", "--dry-run", "12.5", "https://x.y/z", "iphone"} <= found
    assert one(spark, "", X.anchors) == [] and one(spark, "", X.tokens) == []


def test_assemble(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, "user", None)], "k int, t int, r string, c string")
    got = {r.k: [(t.content, t.role) for t in r.conversations] for r in conv.assemble(df, "k", "t", "r", "c").collect()}
    assert got == {1: [("a", "user"), ("b", "assistant")], 2: [(None, "user")]}


def test_casefold_agrees_with_python(spark):
    chars = [chr(k) for k in range(1, 0x2FFF) if chr(k).isalpha()]
    rows = [(c, c.casefold()) for c in chars] + [("Straße ΟΔΟΣ", "strasse οδοσ"), ("İI", "İI".casefold())]
    got = spark.createDataFrame(rows, "c string, f string").select("c", "f", X.casefold(F.col("c")).alias("k"), X.casefold(F.col("f")).alias("kf")).collect()
    assert [r.c for r in got if r.k != r.kf and len(r.c) == 1 and not 0x13A0 <= ord(r.c) <= 0x13FF] == []  # folding again changes nothing
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, set()).add(r.f)
    assert {k: v for k, v in by_key.items() if len(v) > 1 and not all(0x13A0 <= ord(x[0]) for x in v)} == {}  # and joins no letters that differ
    assert got[-2].k == got[-2].f
